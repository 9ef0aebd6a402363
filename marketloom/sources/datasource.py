"""The protocol of a tick source, and a source over a store."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.sources.store import Store
from marketloom.types import RestoreConfig


class TickSource(Protocol):
    def symbol_count(self) -> int: ...

    def provider_count(self) -> int: ...

    def restore_config(self, symbol: int, provider: int) -> RestoreConfig: ...

    def fetch_ticks(self, symbol: int, provider: int, start_ms: int, end_ms: int) -> DataFrame: ...


class StoreSource:
    """Ticks of a store; a provider is an exchange."""

    def __init__(self, store: Store, configs: dict[tuple[int, int], RestoreConfig] | None = None):
        self.store, self.configs = store, configs or {}

    def _distinct(self, column: str) -> int:
        return self.store.scan("ticks").agg(F.countDistinct(column)).first()[0]

    def symbol_count(self) -> int:
        return self._distinct("symbol_id")

    def provider_count(self) -> int:
        return self._distinct("exchange_id")

    def restore_config(self, symbol: int, provider: int) -> RestoreConfig:
        return self.configs.get((symbol, provider), RestoreConfig())

    def fetch_ticks(self, symbol: int, provider: int, start_ms: int, end_ms: int) -> DataFrame:
        return self.store.read("ticks", "UNKNOWN", start_ms, end_ms, exchange=provider, symbol=symbol)

    def fetch_index(self, index: int, symbols: int, start_ms: int, end_ms: int) -> DataFrame:
        return self.fetch_ticks(index % symbols, index // symbols, start_ms, end_ms)
