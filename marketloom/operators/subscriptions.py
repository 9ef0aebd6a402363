"""Subscriptions (listener, symbol_id, provider_id, period_ms) and the notifications that timers give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.timeframe import floor_to


def checked(subs: DataFrame) -> DataFrame:
    """A period of 0 or less is an error."""
    bad = F.raise_error(F.lit("a timer period must be positive")).cast("long")
    return subs.withColumn("period_ms", F.when(F.col("period_ms") > 0, F.col("period_ms").cast("long")).otherwise(bad))


def subscribed(ticks: DataFrame, subs: DataFrame, on: Sequence[str] = ("symbol_id",)) -> DataFrame:
    """Ticks that any listener wants, each once."""
    return ticks.join(subs.select(*on).distinct(), [*on], "left_semi")


def timer_groups(subs: DataFrame) -> DataFrame:
    """One row a period: its listeners and the union of their instruments."""
    return checked(subs).groupBy("period_ms").agg(
        F.countDistinct("listener").alias("listeners"), F.countDistinct("symbol_id").alias("instruments")
    )


def start(subs: DataFrame, at_ms: int) -> DataFrame:
    """One START notification a listener."""
    return checked(subs).select("listener").distinct().select("listener", F.lit("TEST_START").alias("event"), F.lit(at_ms).cast("long").alias("time_ms"))


def unsubscribe(subs: DataFrame, gone: DataFrame, on: Sequence[str] = ("listener", "symbol_id", "provider_id")) -> DataFrame:
    return subs.join(gone.select(*on).distinct(), [*on], "left_anti")


def next_fire(time_ms, period_ms):
    return floor_to(time_ms, period_ms) + period_ms


def timer_batches(ticks: DataFrame, subs: DataFrame) -> DataFrame:
    """For each listener, period and due time: the ticks of its instruments in the period before, and its last price.

    Ticks are first summed by instrument and period length, of which there are few, so a listener's fan-out acts on sums.
    """
    subs = checked(subs).select("listener", "symbol_id", "period_ms").distinct()
    wanted = subs.select("symbol_id", "period_ms").distinct()
    due = next_fire("time_ms", F.col("period_ms"))
    last = F.max_by("last", F.struct("time_ms", "seq"))
    summed = ticks.join(wanted, "symbol_id").groupBy("symbol_id", "period_ms", due.alias("fire_ms")).agg(
        F.count("*").alias("ticks"), last.alias("last"), F.max(F.struct("time_ms", "seq")).alias("at")
    )
    return summed.join(subs, ["symbol_id", "period_ms"]).groupBy("listener", "period_ms", "fire_ms").agg(
        F.sum("ticks").alias("ticks"), F.count("*").alias("instruments"), F.max_by("last", F.struct("at", "symbol_id")).alias("last")
    )


def update(subs: DataFrame, ticks: DataFrame, last_ms: int, now_ms: int, next_ms: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """One step of the bus: listeners of the periods that are due by now get one notification each, with their ticks of [last, now), whether
    the step reaches one due time or several. Returns the rows and the due times after."""
    due = [p for p, t in next_ms.items() if t <= now_ms]
    later = {p: now_ms - now_ms % p + p if t <= now_ms else t for p, t in next_ms.items()}
    seen = ticks.where((F.col("time_ms") >= last_ms) & (F.col("time_ms") < now_ms))
    pairs = checked(subs).where(F.col("period_ms").isin(*due) if due else F.lit(False)).select("listener", "symbol_id").distinct()
    sent = seen.groupBy("symbol_id").agg(F.count("*").alias("ticks")).join(pairs, "symbol_id").groupBy("listener").agg(F.sum("ticks").alias("ticks"))
    return sent, later
