"""Bid and ask restored from last-trade ticks.

The first tick of an hour is always quoted, so prices are carried within an hour only; what crosses hours is the tick before and
the last two spread flips. Both are taken from a summary of one row an hour, so a series is spread over as many tasks as it has hours: the
ticks are exchanged once, by series and hour, and only the summary is ordered by series.

A flip is a buy after a sell at a higher price, or a sell after a buy at a lower one; its spread is the price move. State is carried over
contiguous hours; an hour without ticks starts anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom import types
from marketloom.functions import fixedpoint, flags
from marketloom.functions.timeframe import HOUR, period_number

MODELS = {"NONE": "none", "FIXED_SPREAD": "fixed", "DYNAMIC_SPREAD": "dynamic", "MEDIAN_SPREAD": "median"}
#: A model's spread at a quoted tick, from the flips; further models may be registered.
CUSTOM: dict = {}


def _hours(ticks: DataFrame, keys: Sequence[str], columns: list[Column]) -> DataFrame:
    """One row an hour: run (number of the contiguous stretch) and the given aggregates."""
    one = ticks.groupBy(*keys, "hour").agg(*columns)
    order = Window.partitionBy(*keys).orderBy("hour")
    gap = F.coalesce(F.col("hour") - F.lag("hour").over(order) > 1, F.lit(False)).cast("int")
    return one.withColumn("run", F.sum(gap).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def restore(ticks: DataFrame, config: types.RestoreConfig, codec: types.TickCodecConfig | None = None, keys: Sequence[str] = ("symbol_id",), literal_scale: bool = False) -> DataFrame:
    """ticks (keys, seq, time_ms, last, flags, ...) with bid and ask, and flags as restored. NONE leaves prices alone.

    A quoted tick with neither side is an error. literal_scale multiplies fixed_spread by 10^digits where points mean 10^-digits.
    """
    if config.mode not in MODELS and config.mode not in CUSTOM:
        raise ValueError(f"no bid/ask model {config.mode}")
    digits = config.price_digits or (codec.price_digits if codec else 0)
    scale = fixedpoint.power10(digits)
    seed = F.lit(float(config.fixed_spread) * scale if literal_scale else float(config.fixed_spread) / scale)
    names = [c for c in ticks.columns if c not in ("bid", "ask")]
    hourly = [*keys, "hour"]
    order = Window.partitionBy(*hourly).orderBy("time_ms", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = ticks.select(*names, period_number("time_ms", HOUR).alias("hour"))

    end = F.max_by(F.struct("last", "flags"), F.struct("time_ms", "seq")).alias("end")
    hours = _hours(rows, keys, [end])
    run = Window.partitionBy(*keys, "run").orderBy("hour")
    carried = hours.select(*hourly, "run", F.lag("end").over(run).alias("before"))
    rows = rows.withColumn("first", F.row_number().over(order) == 1)
    rows = rows.withColumn("pl", F.lag("last").over(order)).withColumn("pf", F.lag("flags").over(order)).join(carried, hourly)
    rows = rows.withColumn("pl", F.when(F.col("first"), F.col("before.last")).otherwise(F.col("pl")))
    rows = rows.withColumn("pf", F.when(F.col("first"), F.col("before.flags")).otherwise(F.col("pf")))
    seam = F.col("first") & F.col("pl").isNotNull() & (F.abs(F.col("last") - F.col("pl")) > 1.0 / scale)
    rows = rows.withColumn("flags", F.when(seam, flags.put(F.col("flags"), types.LAST_UPDATED)).otherwise(F.col("flags")))
    if config.mode == "NONE":
        return rows.select(*names)

    updated, buy, sell = (flags.has(F.col("flags"), b) for b in (types.LAST_UPDATED, types.FROM_BUY, types.FROM_SELL))
    quoted = F.col("first") | updated
    flip = (buy & flags.has(F.col("pf"), types.FROM_SELL) & (F.col("last") > F.col("pl"))) | (~buy & flags.has(F.col("pf"), types.FROM_BUY) & (F.col("last") < F.col("pl")))
    move = fixedpoint.normalize(F.abs(F.col("last") - F.col("pl")), digits)
    rows = rows.withColumn("quoted", quoted).withColumn("flip", F.when(quoted & F.coalesce(flip, F.lit(False)), move))
    if config.mode == "FIXED_SPREAD":
        rows = rows.withColumn("spread_now", seed)
    else:
        flips = rows.where("flip IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy(*hourly).orderBy(F.desc("time_ms"), F.desc("seq")))).where("nth <= 2")
        ends = flips.groupBy(*hourly).agg(F.max(F.when(F.col("nth") == 1, F.col("flip"))).alias("f1"), F.max(F.when(F.col("nth") == 2, F.col("flip"))).alias("f2"))
        held = carried.select(*hourly, "run").join(ends, hourly, "left")
        earlier = run.rowsBetween(Window.unboundedPreceding, -1)
        held = held.withColumn("f2", F.coalesce("f2", F.last("f1", True).over(earlier)))
        pair = F.last(F.when(F.col("f1").isNotNull(), F.struct("f1", "f2")), True).over(earlier)
        held = held.select(*hourly, pair.alias("held")).select(*hourly, F.col("held.f1").alias("c1"), F.col("held.f2").alias("c2"))
        rows = rows.join(held, hourly)
        if config.mode == "DYNAMIC_SPREAD":
            now = F.coalesce(F.last("flip", True).over(so_far), F.col("c1"), seed)
        elif config.mode == "MEDIAN_SPREAD":
            past = order.rowsBetween(Window.unboundedPreceding, -1)
            prev = F.last("flip", True).over(past)
            rows = rows.withColumn("prev", prev)
            # The flip before the last one: what stood before that flip, carried from its row.
            rows = rows.withColumn("prev2", F.last(F.when(F.col("flip").isNotNull(), F.struct(F.col("prev").alias("x"))), True).over(past)["x"])
            p1 = F.coalesce("prev", "c1")
            p2 = F.when(F.col("prev").isNull(), F.col("c2")).otherwise(F.coalesce("prev2", "c1"))
            median = fixedpoint.median3(F.coalesce(p2, seed), F.coalesce(p1, seed), F.col("flip"))
            rows = rows.withColumn("median", F.when(F.col("flip").isNotNull(), median))
            now = F.coalesce(F.last("median", True).over(so_far), F.col("c1"), seed)
        else:
            now = CUSTOM[config.mode](order, seed)
        rows = rows.withColumn("spread_now", now)
    error = F.raise_error(F.lit("a quoted tick has neither side")).cast("double")
    at = lambda x, y: F.when(~F.col("quoted"), F.lit(None).cast("double")).when(buy, x).when(sell, y).otherwise(error)
    rows = rows.withColumn("ask0", at(F.col("last"), F.col("last") + F.col("spread_now"))).withColumn("bid0", at(F.col("last") - F.col("spread_now"), F.col("last")))
    marked = flags.put_if(F.col("flags"), types.ASK_UPDATED | types.BID_UPDATED, updated)
    columns = [marked.alias("flags") if c == "flags" else F.col(c) for c in names]
    return rows.select(*columns, F.last("bid0", True).over(so_far).alias("bid"), F.last("ask0", True).over(so_far).alias("ask"))


def mark_last_updated(ticks: DataFrame, keys: Sequence[str] = ("symbol_id",), first: float | None = -1.0, digits: int | None = None) -> DataFrame:
    """LAST_UPDATED where the price differs from the tick before; a series' first tick is compared with `first` (None: left as it is)."""
    before = F.lag("last").over(Window.partitionBy(*keys).orderBy("time_ms", "seq"))
    before = before if first is None else F.coalesce(before, F.lit(first))
    moved = F.col("last") != before if digits is None else F.abs(F.col("last") - before) > fixedpoint.tolerance(digits)
    return ticks.withColumn("flags", flags.put_if(F.col("flags"), types.LAST_UPDATED, F.coalesce(moved, F.lit(False))))
