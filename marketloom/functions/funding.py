"""Funding payments by exchange; a registry takes further rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A fixed value: the length in milliseconds of the period that rates are stated for.
FULL_PERIOD = 28_800_000


def default_payment(rate: Column, size: Column, mark: Column, premium: Column, period: Column) -> Column:
    """Without a mark price, a size is taken as a value."""
    return F.when(mark != 0, size * mark * rate).otherwise(size * rate)


def _scaled(rate: Column, size: Column, mark: Column, period: Column) -> Column:
    return rate * (size * mark) * (period / F.lit(float(FULL_PERIOD)))


def binance_payment(rate: Column, size: Column, mark: Column, premium: Column, period: Column) -> Column:
    return _scaled(F.when(premium != 0, rate * (premium + 1)).otherwise(rate), size, mark, period)


def bybit_payment(rate: Column, size: Column, mark: Column, premium: Column, period: Column) -> Column:
    return _scaled(F.when(premium != 0, rate + premium).otherwise(rate), size, mark, period)


Payment = Callable[[Column, Column, Column, Column, Column], Column]
RULES: dict[str, Payment] = {"BINANCE": binance_payment, "BYBIT": bybit_payment}


def register(name: str, rule: Payment) -> None:
    """A rule builds a Column; a pandas UDF can stand in for what Columns can't say."""
    RULES[name] = rule


def payment(kind: str, custom: Payment | None = None) -> Payment:
    """The rule of that kind; CUSTOM takes the one given, or else the default."""
    if kind == "CUSTOM":
        return custom or default_payment
    if kind not in RULES:
        raise ValueError(f"no funding rule {kind}")
    return RULES[kind]
