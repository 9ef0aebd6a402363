"""Bars: from ticks, resampled, gap-filled, split and cropped.

Every aggregate takes the floor of a time as its bucket, so it runs with partial sums and one exchange; gaps don't matter to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom import types
from marketloom.functions import flags as flag
from marketloom.functions.timeframe import SECONDS, SEGMENT, floor_to

SUMMED = ("volume", "quote_volume", "buy_volume", "buy_quote_volume", "tick_volume")


def _present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def _first(column: str, order: Column) -> Column:
    return F.min_by(column, order)


def ticks_to_bars(ticks: DataFrame, interval_ms: int, keys: Sequence[str] = ("symbol_id",), price: str = "last") -> DataFrame:
    """Bars of one price basis (last, bid or ask). Ticks need time_ms, seq, volume and flags; a spread column gives the spread at the close.

    quote volume is price times volume, buy volumes are those of ticks with FROM_BUY, tick_volume counts ticks.
    """
    order = F.struct("time_ms", "seq")
    quote, buy = F.col(price) * F.col("volume"), flag.has(F.col("flags"), types.FROM_BUY)
    spread = F.max_by("spread", order) if "spread" in ticks.columns else F.lit(0).cast("long")
    out = ticks.groupBy(*keys, floor_to("time_ms", interval_ms).alias("bucket")).agg(
        _first(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.sum("volume").alias("volume"), F.sum(quote).alias("quote_volume"),
        F.sum(F.when(buy, F.col("volume")).otherwise(F.lit(0.0))).alias("buy_volume"), F.sum(F.when(buy, quote).otherwise(F.lit(0.0))).alias("buy_quote_volume"),
        spread.cast("long").alias("spread"), F.count("*").alias("tick_volume"),
    )
    return out.withColumnRenamed("bucket", "time_ms")


def resample(bars: DataFrame, interval_ms: int, spread: str, keys: Sequence[str] = ("symbol_id",)) -> DataFrame:
    """spread: last, max, avg (the whole part of the mean) or none (0)."""
    how = {
        "last": lambda: F.max_by("spread", "time_ms"),
        "max": lambda: F.max("spread"),
        "avg": lambda: F.expr("sum(spread) div count(*)"),
        "none": lambda: F.lit(0),
    }[spread]()
    out = bars.groupBy(*keys, floor_to("time_ms", interval_ms).alias("bucket")).agg(
        _first("open", F.col("time_ms")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time_ms").alias("close"),
        *(F.sum(c).alias(c) for c in _present(bars, SUMMED)), how.cast("long").alias("spread"),
    )
    return out.withColumnRenamed("bucket", "time_ms")


def resample_bars(bars: DataFrame, interval_ms: int, config: types.BarCodecConfig, keys: Sequence[str] = ("symbol_id",)) -> DataFrame:
    """The spread rule follows the flags: none without ENABLE_SPREAD, else last before max before avg; without one, an error."""
    if not config.has(types.ENABLE_SPREAD):
        return resample(bars, interval_ms, "none", keys)
    for bit, how in ((types.SPREAD_LAST, "last"), (types.SPREAD_MAX, "max"), (types.SPREAD_AVG, "avg")):
        if config.has(bit):
            return resample(bars, interval_ms, how, keys)
    raise ValueError("bars with a spread need SPREAD_LAST, SPREAD_MAX or SPREAD_AVG")


def resample_frame(bars: DataFrame, frame: str, config: types.BarCodecConfig, keys: Sequence[str] = ("symbol_id",)) -> DataFrame:
    return resample_bars(bars, 1000 * SECONDS[frame], config, keys)


def _filled(bars: DataFrame, grid: DataFrame, how: str, lead: str, keys: Sequence[str]) -> DataFrame:
    """Grid rows without a bar take the last close before them, those before any bar the first bar's `lead`; volumes are 0.

    The last close and the first bar come from one window a series. A series is cut nowhere, as each filler may reach back to its start.
    """
    ordered = Window.partitionBy(*keys).orderBy("time_ms")
    so_far, all_ = ordered.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy("time_ms").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    real = F.col("close").isNotNull()
    joined = grid.join(bars, [*keys, "time_ms"], how)
    price = F.coalesce(F.last("close", True).over(so_far), F.first(lead, True).over(all_))
    spread = F.coalesce(F.last("spread", True).over(so_far), F.first("spread", True).over(all_))
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast(dict(bars.dtypes)[c])).alias(c) for c in _present(bars, SUMMED)}
    columns = [
        F.when(real, F.col(c)).otherwise(price).alias(c) if c in ("open", "high", "low", "close")
        else F.when(real, F.col(c)).otherwise(spread).alias(c) if c == "spread" else zero.get(c, F.col(c))
        for c in bars.columns
    ]
    return joined.select(*columns)


def _grid(bounds: DataFrame, interval_ms: int, keys: Sequence[str]) -> DataFrame:
    """A row for each step in [low, high) of each series."""
    steps = F.sequence(F.col("low"), F.col("high") - 1, F.lit(interval_ms).cast("long"))
    return bounds.where("low < high").select(*keys, F.explode(steps).alias("time_ms"))


def fill_bars(bars: DataFrame, interval_ms: int, start_ms: int, end_ms: int, keys: Sequence[str] = ("symbol_id",)) -> DataFrame:
    """Exactly the grid [start, end) of each series that has bars there; fillers before its first bar take that bar's close.

    Bars off the grid or outside it are left out first.
    """
    inside = bars.where((F.col("time_ms") >= start_ms) & (F.col("time_ms") < end_ms)).where(F.pmod(F.col("time_ms") - start_ms, F.lit(interval_ms)) == 0)
    bounds = inside.select(*keys).distinct().select(*keys, F.lit(start_ms).cast("long").alias("low"), F.lit(end_ms).cast("long").alias("high"))
    return _filled(inside, _grid(bounds, interval_ms, keys), "left", "close", keys)


def fill_bars_in_place(bars: DataFrame, interval_ms: int, start_ms: int, end_ms: int, keys: Sequence[str] = ("symbol_id",)) -> DataFrame:
    """All bars stay, those outside [start, end) too; fillers before a series' first bar take its open. Gaps are filled from the earlier
    of start and the first bar to the later of end and the last bar, on the grid that start lies on."""
    low = F.least(F.lit(start_ms).cast("long"), F.min("time_ms"))
    low = F.lit(start_ms).cast("long") - F.floor((start_ms - low) / interval_ms).cast("long") * interval_ms
    bounds = bars.groupBy(*keys).agg(low.alias("low"), F.greatest(F.lit(end_ms).cast("long"), F.max("time_ms") + 1).alias("high"))
    return _filled(bars, _grid(bounds, interval_ms, keys), "full", "open", keys)


def fill_bars_frame(bars: DataFrame, frame: str, start_ms: int, end_ms: int, keys: Sequence[str] = ("symbol_id",), in_place: bool = False) -> DataFrame:
    return (fill_bars_in_place if in_place else fill_bars)(bars, 1000 * SECONDS[frame], start_ms, end_ms, keys)


def project(rows: DataFrame, schema: str, keys: Sequence[str] = ()) -> DataFrame:
    """The columns of a smaller tick or bar type (a schema of types), beside the keys."""
    return rows.select(*keys, *(c.strip().split()[0] for c in schema.split(",") if c.strip().split()[0] not in keys))


def crop_before(rows: DataFrame, start_ms: int) -> DataFrame:
    return rows.where(F.col("time_ms") >= start_ms)


def crop_after(rows: DataFrame, end_ms: int) -> DataFrame:
    return rows.where(F.col("time_ms") < end_ms)


def segment_of(time_ms: Column | str, duration_ms: int) -> Column:
    return (floor_to(time_ms, duration_ms) / duration_ms).cast("long")


def split_bars(bars: DataFrame, frame: str) -> DataFrame:
    """Adds the number of the storage segment that a bar of that frame lies in."""
    if frame not in SEGMENT:
        raise ValueError(f"frame {frame} isn't kept in segments")
    return bars.withColumn("segment", segment_of("time_ms", SEGMENT[frame]))


def split_ticks(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("hour", segment_of("time_ms", 3_600_000))


def out_of_order(rows: DataFrame, keys: Sequence[str] = ("symbol_id",), seq: str = "seq", strict: bool = False) -> DataFrame:
    """The number of rows a series whose time is before that of the row before by seq; strict: or equal to it."""
    before = F.lag("time_ms").over(Window.partitionBy(*keys).orderBy(seq))
    bad = F.col("time_ms") <= before if strict else F.col("time_ms") < before
    return rows.select(*keys, F.coalesce(bad, F.lit(False)).cast("long").alias("bad")).groupBy(*keys).agg(F.sum("bad").alias("out_of_order"))


def second_index(ticks: DataFrame, keys: Sequence[str] = ("symbol_id",), period_ms: int = 1000, span: int = 3600) -> DataFrame:
    """For each second of an hour that has ticks, the place of the first tick at or after it; `ticks` of the hour and the last place."""
    hour = floor_to("time_ms", period_ms * span)
    placed = ticks.select(*keys, "time_ms", "seq", hour.alias("hour_ms"))
    n = F.row_number().over(Window.partitionBy(*keys, "hour_ms").orderBy("time_ms", "seq")) - 1
    placed = placed.withColumn("place", n).withColumn("second", ((F.col("time_ms") - F.col("hour_ms") + period_ms - 1) / period_ms).cast("int"))
    ready = placed.groupBy(*keys, "hour_ms", "second").agg(F.min("place").alias("first"))
    return ready.withColumn("first", F.min("first").over(Window.partitionBy(*keys, "hour_ms").orderBy("second").rowsBetween(0, Window.unboundedFollowing)))


def latest(rows: DataFrame, keys: Sequence[str] = ("symbol_id",), at_ms: int | None = None, seq: str = "seq") -> DataFrame:
    """The last row of each series, at or before a time if one is given."""
    seen = rows if at_ms is None else rows.where(F.col("time_ms") <= at_ms)
    rest = [c for c in rows.columns if c not in keys]
    got = seen.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("time_ms", seq)).alias("row"))
    return got.select(*keys, "row.*")


def at_offset(rows: DataFrame, offset: int, keys: Sequence[str] = ("symbol_id",), seq: str = "seq") -> DataFrame:
    """The row that many places before the last of each series."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("time_ms"), F.desc(seq)))
    return rows.withColumn("place", n).where(F.col("place") <= offset + 1).where(F.col("place") == offset + 1).drop("place")


def series_counts(rows: DataFrame, keys: Sequence[str] = ("symbol_id",)) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("time_ms").alias("start_ms"), F.max("time_ms").alias("end_ms"), F.count("*").alias("n"))
