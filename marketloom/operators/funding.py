"""Funding series: reads, upserts, neighbours in time, and pairs of opposite rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.funding import payment
from marketloom.functions.timeframe import nearest_hour

KEY = ("provider_id", "symbol_id")


def between(rows: DataFrame, start_ms: int, end_ms: int, provider_id: int | None = None, symbol_id: int | None = None) -> DataFrame:
    """Both ends are inside."""
    out = rows.where(F.col("time_ms").between(start_ms, end_ms))
    out = out if provider_id is None else out.where(F.col("provider_id") == provider_id)
    return out if symbol_id is None else out.where(F.col("symbol_id") == symbol_id)


def _last(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    got = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return got.select(*keys, "row.*")


def latest_by_hour(rows: DataFrame, order: Sequence[str] = ("time_ms",)) -> DataFrame:
    """One row a series and hour, rounded to the nearest; the last written wins."""
    return _last(rows.withColumn("hour", nearest_hour("time_ms")), [*KEY, "hour"], order)


def insert_or_replace(held: DataFrame, new: DataFrame) -> DataFrame:
    """The union, in which a new row replaces that of its primary key (provider, symbol, time); of several new ones the last by `written`, if there."""
    columns = held.columns
    both = held.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)), allowMissingColumns=True)
    order = ["age", *(["written"] if "written" in both.columns else [])]
    return _last(both, [*KEY, "time_ms"], order).select(*columns)


def periods(rows: DataFrame) -> DataFrame:
    """prev_ms, next_ms and period_ms (to the time before) of each row."""
    w = Window.partitionBy(*KEY).orderBy("time_ms")
    before = F.lag("time_ms").over(w)
    return rows.withColumns({"prev_ms": before, "next_ms": F.lead("time_ms").over(w), "period_ms": F.col("time_ms") - before})


def payments(rows: DataFrame, kind: str, size: str = "size", custom=None) -> DataFrame:
    rule = payment(kind, custom)
    return rows.withColumn("payment", rule(*(F.col(c) for c in ("funding_rate", size, "mark_price", "premium_index", "period_ms"))))


def opposite_pairs(rows: DataFrame) -> DataFrame:
    """At one time and symbol, each venue of a positive rate beside each of a negative one, with the difference."""
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("provider_id", "funding_rate", "mark_price")]
    up = rows.where("funding_rate > 0").select("symbol_id", "time_ms", *side("a"))
    down = rows.where("funding_rate < 0").select("symbol_id", "time_ms", *side("b"))
    return up.join(down, ["symbol_id", "time_ms"]).withColumn("rate_difference", F.col("funding_rate_a") - F.col("funding_rate_b"))


def rate_pairs(rows: DataFrame) -> DataFrame:
    """The venue of the lowest and that of the highest rate of a symbol at a time: buy and sell, and buy rate less sell rate."""
    got = rows.groupBy("symbol_id", "time_ms").agg(
        F.min(F.struct("funding_rate", "provider_id")).alias("buy"), F.max(F.struct("funding_rate", "provider_id")).alias("sell"), F.count("*").alias("n")
    ).where("n > 1")
    return got.select(
        "symbol_id", "time_ms", F.col("buy.provider_id").alias("buy_provider"), F.col("sell.provider_id").alias("sell_provider"),
        (F.col("buy.funding_rate") - F.col("sell.funding_rate")).alias("rate_difference"),
    )


def metadata(rows: DataFrame) -> DataFrame:
    """start_ms, end_ms, next_ms (end and the last period) and period_ms of each series."""
    last = F.max_by("period_ms", "time_ms")
    out = periods(rows).groupBy(*KEY).agg(F.min("time_ms").alias("start_ms"), F.max("time_ms").alias("end_ms"), last.alias("period_ms"), F.count("*").alias("n"))
    return out.withColumn("next_ms", F.col("end_ms") + F.col("period_ms"))
