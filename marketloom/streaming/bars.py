"""Streams of ticks: windowed bars, ordered appends, keyed restoration, and notifications of listeners."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom import types
from marketloom.functions.timeframe import HOUR, floor_to
from marketloom.operators.subscriptions import checked


def tick_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def stream_bars(ticks: DataFrame, interval_ms: int, delay: str = "0 seconds", keys: Sequence[str] = ("symbol_id",)) -> DataFrame:
    """Bars in append mode: a bar comes once its window is past the watermark; ticks that are later than `delay` are dropped."""
    timed = ticks.withColumn("ts", F.timestamp_millis("time_ms")).withWatermark("ts", delay)
    order = F.struct("time_ms", "seq")
    out = timed.groupBy(*keys, F.window("ts", f"{interval_ms} milliseconds")).agg(
        F.min_by("last", order).alias("open"), F.max("last").alias("high"), F.min("last").alias("low"), F.max_by("last", order).alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("tick_volume"),
    )
    return out.withColumn("time_ms", F.unix_millis("window.start")).drop("window")


def _in_order(rows: pd.DataFrame, state: tuple | None, gap: float, mark: bool, on_late: str) -> tuple[pd.DataFrame, tuple]:
    """One series' new ticks whose time rises strictly, marked where the price differs from the tick before by over `gap`."""
    time, last = state if state else (None, None)
    rows = rows.sort_values(["time_ms", "seq"], kind="stable")
    times = rows["time_ms"].to_numpy()
    before = np.concatenate(([-1 if time is None else time], times[:-1]))
    good = times > before
    if on_late == "raise" and not good.all():
        raise ValueError("ticks must be in chronological order")
    rows = rows[good].copy()
    if mark and len(rows):
        price = rows["last"].to_numpy()
        moved = np.abs(price - np.concatenate(([np.nan if last is None else last], price[:-1]))) > gap
        rows["flags"] = rows["flags"].to_numpy() | np.where(moved, types.LAST_UPDATED, 0)
    return rows, (int(rows["time_ms"].iloc[-1]), float(rows["last"].iloc[-1])) if len(rows) else (time, last)


def ordered(ticks: DataFrame, keys: Sequence[str] = ("symbol_id",), mark: bool = True, digits: int | None = None, on_late: str = "drop") -> DataFrame:
    """The ticks of a stream whose time is past that of the tick before in their series, over micro-batches too; others are dropped or
    raise. mark sets LAST_UPDATED where the price has moved, by over half a unit of the last of `digits` places if given; a series' first tick stays as it is."""
    gap = 0.0 if digits is None else 0.5 / 10**digits

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows, after = _in_order(pd.concat(list(batches)), state.get if state.exists else None, gap, mark, on_late)
        if after[0] is not None:
            state.update(after)
        yield rows

    from pyspark.sql.streaming.state import GroupStateTimeout

    return ticks.groupBy(*keys).applyInPandasWithState(run, ticks.schema, "time_ms long, last double", "append", GroupStateTimeout.NoTimeout)


def append_hours(ticks: DataFrame, path: str, checkpoint: str):
    """A query that appends ticks, such as `ordered` gives, to folders by their own hour."""
    rows = ticks.withColumn("hour", (floor_to("time_ms", HOUR) / HOUR).cast("long"))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("hour").trigger(availableNow=True)


STATE = "last double, flags long, spread double, before double, hour long, time_ms long, seq long, bid double, ask double, median double"
RESTORED = "symbol_id long, seq long, time_ms long, last double, flags long, bid double, ask double"


def _restored(rows: pd.DataFrame, state: tuple | None, mode: str, seed: float, scale: float, on_late: str) -> tuple[pd.DataFrame, tuple]:
    """One series' new ticks in order, and its state after them: the tick before, the last two flips, the hour, the last time, and
    what the open hour has come to: its prices and its median."""
    last, flags, f1, f2, hour, time, seq, bid, ask, median = state if state else (None, 0, None, None, None, -1, -1, None, None, None)
    out = []
    for r in rows.sort_values(["time_ms", "seq"]).itertuples(index=False):
        if (r.time_ms, r.seq) <= (time, seq):
            if on_late == "raise":
                raise ValueError("a tick is late")
            continue
        now = r.time_ms // HOUR
        first = now != hour
        if first and hour is not None and now != hour + 1:
            last, flags, f1, f2 = None, 0, None, None
        mark = r.flags
        if first:
            if last is not None and abs(r.last - last) > 1 / scale:
                mark |= types.LAST_UPDATED
            median = f1
        if first or mark & types.LAST_UPDATED:
            buy, sell = mark & types.FROM_BUY, mark & types.FROM_SELL
            if not buy and not sell:
                raise ValueError("a quoted tick has neither side")
            if last is not None and (buy and flags & types.FROM_SELL and r.last > last or not buy and flags & types.FROM_BUY and r.last < last):
                flip = int(abs(r.last - last) * scale + 0.5) / scale
                a, b = (f2 if f2 is not None else seed), (f1 if f1 is not None else seed)
                median = max(min(a, b), min(max(a, b), flip))
                f1, f2 = flip, f1
            held = {"FIXED_SPREAD": None, "DYNAMIC_SPREAD": f1, "MEDIAN_SPREAD": median}[mode]
            spread = seed if held is None else held
            ask, bid = (r.last, r.last - spread) if buy else (r.last + spread, r.last)
            if mark & types.LAST_UPDATED:
                mark |= types.ASK_UPDATED | types.BID_UPDATED
        out.append((r.symbol_id, r.seq, r.time_ms, r.last, mark, bid, ask))
        last, flags, hour, time, seq = r.last, r.flags, now, r.time_ms, r.seq
    return pd.DataFrame(out, columns=[c.split()[0] for c in RESTORED.split(", ")]), (last, flags, f1, f2, hour, time, seq, bid, ask, median)


def stream_restore(ticks: DataFrame, config: types.RestoreConfig, on_late: str = "drop") -> DataFrame:
    """Bid and ask restored tick by tick, with the state of each series kept over micro-batches, the open hour's included, so the result
    doesn't depend on where batches end. on_late: drop or raise."""
    if config.mode not in ("FIXED_SPREAD", "DYNAMIC_SPREAD", "MEDIAN_SPREAD"):
        raise ValueError(f"no model {config.mode} on streams")
    scale = float(10**config.price_digits)
    seed, mode = config.fixed_spread / scale, config.mode

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        got, after = _restored(rows, state.get if state.exists else None, mode, seed, scale, on_late)
        state.update(after)
        yield got

    from pyspark.sql.streaming.state import GroupStateTimeout

    return ticks.groupBy("symbol_id").applyInPandasWithState(run, RESTORED, STATE, "append", GroupStateTimeout.NoTimeout)


def _due(spark: SparkSession, place: str, number: int) -> tuple[int, dict[int, int]] | None:
    """The last step's time and the due times after the batch before, as that batch has written them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/{number - 1}")
    if number == 0 or not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    held = json.loads(spark.read.text(f"{place}/{number - 1}").first()[0])
    return held["last"], {int(p): t for p, t in held["due"].items()}


def notify(ticks: DataFrame, subs: DataFrame, on_update: Callable[[DataFrame, int], None], checkpoint: str, on: Sequence[str] = ("symbol_id",)):
    """A query that calls on_update(snapshot, batch) for each micro-batch: listener and tick columns of what the listeners want.

    With a period_ms in subs a batch is a step of the bus to its last tick: only listeners whose period has come due by then are told,
    of the batch's ticks, and a step over several periods is one notification; due times stand beside the checkpoint, by batch, so
    they survive a restart and a batch that runs again finds those of before. Without periods every batch is told.
    """
    place = f"{checkpoint}-due"
    periods = [r[0] for r in checked(subs).select("period_ms").distinct().collect()] if "period_ms" in subs.columns else None

    def batch(rows: DataFrame, number: int) -> None:
        wanted = subs
        if periods is not None:
            spark = rows.sparkSession
            span = rows.agg(F.min("time_ms"), F.max("time_ms")).first()
            before = _due(spark, place, number)
            if span[0] is None:
                last, due = before or (0, {})
            else:
                last, due = before or (span[0], {p: span[0] - span[0] % p + p for p in periods})
            now = max(last, span[1] or 0)
            told = [p for p, t in due.items() if t <= now]
            after = {p: now - now % p + p if t <= now else t for p, t in due.items()}
            spark.createDataFrame([(json.dumps({"last": now, "due": after}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{place}/{number}")
            if not told:
                return
            wanted = subs.where(F.col("period_ms").isin(*told))
        on_update(rows.join(wanted.select("listener", *on).distinct(), [*on]), number)

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
