"""State at a time, and series beside each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(facts: DataFrame, states: DataFrame, keys: Sequence[str], columns: Sequence[str], bucket_ms: int | None = None, time: str = "time_ms", order: Sequence[str] = ()) -> DataFrame:
    """facts with the `columns` of the last state at or before each; null before the first state.

    One union and one window, no range join. A key is one window; with bucket_ms, a window is one bucket of a key, and the state that enters
    a bucket comes from a summary of one row a bucket, so a hot key is spread over its buckets.
    order: columns that settle the order of states of equal time.
    """
    rest = [c for c in facts.columns if c not in keys and c != time]
    state = F.struct(*(F.col(c) for c in columns))
    a = facts.select(*keys, time, F.lit(1).alias("kind"), F.struct(*rest).alias("fact")).withColumn("state", F.lit(None).cast(states.select(state).schema[0].dataType))
    b = states.select(*keys, time, F.lit(0).alias("kind"), F.lit(None).cast(a.schema["fact"].dataType).alias("fact"), state.alias("state"))
    if order:
        tie = F.struct(*order)
        a = a.withColumn("tie", F.lit(None).cast(states.select(tie).schema[0].dataType))
        b = states.select(*keys, time, F.lit(0).alias("kind"), F.lit(None).cast(a.schema["fact"].dataType).alias("fact"), state.alias("state"), tie.alias("tie"))
    both = a.unionByName(b)
    part = [*keys]
    if bucket_ms:
        both, part = both.withColumn("bucket", F.floor(F.col(time) / bucket_ms)), [*keys, "bucket"]
    sort = [time, "kind", *(["tie"] if order else [])]
    so_far = Window.partitionBy(*part).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    both_now = F.last("state", True).over(so_far)
    if bucket_ms:
        ends = both.groupBy(*part).agg(F.max_by("state", F.when(F.col("kind") == 0, F.struct(*(F.col(c) for c in sort)))).alias("end"))
        earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        entering = ends.select(*part, F.last("end", True).over(earlier).alias("entering"))
        both, both_now = both.withColumn("now", both_now).join(entering, part), F.coalesce("now", "entering")
    got = both.withColumn("now", both_now).where("kind = 1")
    return got.select(*keys, time, "fact.*", *(F.col(f"now.{c}").alias(c) for c in columns))


def cross_series(rows: DataFrame, on: Sequence[str], tell: str, columns: Sequence[str]) -> DataFrame:
    """Each two series of equal `on` columns that differ in `tell`, the smaller first, with `columns` of both (suffixes _a, _b)."""
    side = lambda s: rows.select(*on, F.col(tell).alias(f"{tell}_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in columns))
    return side("a").join(side("b"), [*on]).where(F.col(f"{tell}_a") < F.col(f"{tell}_b"))
