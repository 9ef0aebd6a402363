"""The market at a time: a view over ticks and funding, by symbol and provider names or indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators import bars

KEYS = ["provider_id", "symbol_id"]


class Snapshot:
    """ticks: provider_id, symbol_id, seq, time_ms, ...; funding: provider_id, symbol_id, time_ms, funding_rate, mark_price. Of both, what is at or
    before `at_ms`; ticks not before `since_ms`, the time of the snapshot before."""

    def __init__(self, ticks: DataFrame, at_ms: int, since_ms: int = 0, funding: DataFrame | None = None, symbols: list[str] = (), providers: list[str] = ()):
        self._ticks = ticks.where((F.col("time_ms") <= at_ms) & (F.col("time_ms") >= since_ms))
        self._funding = None if funding is None else funding.where(F.col("time_ms") <= at_ms)
        self.at_ms, self.names = at_ms, {"symbol": list(symbols), "provider": list(providers)}

    def index(self, kind: str, name: str) -> int:
        if name not in self.names[kind]:
            raise KeyError(f"no {kind} {name}")
        return self.names[kind].index(name)

    def name(self, kind: str, index: int) -> str:
        return self.names[kind][index]

    def ticks(self, symbol: int | None = None, provider: int | None = None) -> DataFrame:
        out = self._ticks if symbol is None else self._ticks.where(F.col("symbol_id") == symbol)
        return out if provider is None else out.where(F.col("provider_id") == provider)

    def tick(self, offset: int = 0) -> DataFrame:
        """Of each series, the tick that many places before the last."""
        return bars.latest(self._ticks, KEYS) if offset == 0 else bars.at_offset(self._ticks, offset, KEYS)

    def counts(self) -> DataFrame:
        return self._ticks.groupBy(*KEYS).agg(F.count("*").alias("ticks"))

    def funding(self) -> DataFrame:
        """The last funding_rate and mark_price of each series."""
        if self._funding is None:
            raise ValueError("the snapshot has no funding")
        last = self._funding.groupBy(*KEYS).agg(F.max_by(F.struct("funding_rate", "mark_price"), "time_ms").alias("last"))
        return last.select(*KEYS, "last.*")
