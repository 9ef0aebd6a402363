"""What stores hold: their metadata as rows, its union and difference, and the choice of a store for a request."""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SETS = ("market_types", "exchange_ids", "symbol_ids")
FIELDS = ("market_type", "exchange_id", "symbol_id")


def _bound(pick, a: Column, b: Column) -> Column:
    """0 is unset."""
    return F.coalesce(pick(F.nullif(a, F.lit(0)), F.nullif(b, F.lit(0))), F.lit(0).cast("long"))


def merge(a: DataFrame, b: DataFrame, key: str = "store") -> DataFrame:
    """Of each store in both: the union of flags, bounds and sets."""
    x, y = a.alias("x"), b.alias("y")
    sets = [F.array_sort(F.array_union(f"x.{c}", f"y.{c}")).alias(c) for c in SETS]
    return x.join(y, key).select(
        key, F.col("x.data_flags").bitwiseOR(F.col("y.data_flags")).alias("data_flags"),
        _bound(F.least, F.col("x.start_ms"), F.col("y.start_ms")).alias("start_ms"), _bound(F.greatest, F.col("x.end_ms"), F.col("y.end_ms")).alias("end_ms"), *sets,
    )


def subtract(a: DataFrame, b: DataFrame, key: str = "store") -> DataFrame:
    """Of each store in both: flags and set members that the second hasn't; the bounds are those of the overlap."""
    x, y = a.alias("x"), b.alias("y")
    sets = [F.array_sort(F.array_except(f"x.{c}", f"y.{c}")).alias(c) for c in SETS]
    return x.join(y, key).select(
        key, F.col("x.data_flags").bitwiseAND(F.bitwise_not("y.data_flags")).alias("data_flags"),
        F.greatest("x.start_ms", "y.start_ms").alias("start_ms"), F.least("x.end_ms", "y.end_ms").alias("end_ms"), *sets,
    )


def describe(rows: DataFrame, key: str, flags: int) -> DataFrame:
    """The metadata row of each store, from its rows (market_type, exchange_id, symbol_id, time_ms)."""
    sets = [F.array_sort(F.collect_set(c)).alias(n) for c, n in zip(("market_type", "exchange_id", "symbol_id"), SETS)]
    return rows.groupBy(key).agg(F.lit(flags).cast("long").alias("data_flags"), F.min("time_ms").alias("start_ms"), F.max("time_ms").alias("end_ms"), *sets)


def serves(flag: Column | int, market: Column, exchange: Column, symbol: Column, time_ms: Column) -> Column:
    """Whether a metadata row covers a request; a bound of 0 is open."""
    want = F.lit(flag).cast("long") if isinstance(flag, int) else flag
    inside = ((F.col("start_ms") == 0) | (time_ms >= F.col("start_ms"))) & ((F.col("end_ms") == 0) | (time_ms < F.col("end_ms")))
    held = F.array_contains("market_types", market) & F.array_contains("exchange_ids", exchange) & F.array_contains("symbol_ids", symbol)
    return (F.col("data_flags").bitwiseAND(want) != 0) & inside & held


def route(requests: DataFrame, stores: DataFrame, flag: int, key: str = "store", strict: bool = True) -> DataFrame:
    """The first store, by `priority`, that serves each request (request_id, market_type, exchange_id, symbol_id, time_ms).

    Each set of a store is flattened by itself, never their product. strict: an error if none serves a request.
    """
    # A store may have several metadata rows; each is told by its content.
    open_ = stores.where(F.col("data_flags").bitwiseAND(F.lit(flag).cast("long")) != 0).withColumn("held_by", F.xxhash64(key, "priority", "start_ms", "end_ms", *SETS))
    bounds = open_.select("held_by", "priority", F.col(key).alias("held_key"), "start_ms", "end_ms").distinct()
    sets = {c: open_.select("held_by", F.explode(n).alias(c)).distinct() for c, n in zip(FIELDS, SETS)}
    return _routed(requests, bounds, sets, key, strict)


def route_held(requests: DataFrame, held: DataFrame, key: str = "store", strict: bool = True) -> DataFrame:
    """`route` by the rows that stores hold (key, priority, market_type, exchange_id, symbol_id, time_ms), whose sets are never gathered in one row."""
    held = held.withColumn("held_by", F.xxhash64(key, "priority"))
    bounds = held.groupBy("held_by", "priority", F.col(key).alias("held_key")).agg(F.min("time_ms").alias("start_ms"), F.max("time_ms").alias("end_ms"))
    return _routed(requests, bounds, {c: held.select("held_by", c).distinct() for c in FIELDS}, key, strict)


def _routed(requests: DataFrame, bounds: DataFrame, sets: dict[str, DataFrame], key: str, strict: bool) -> DataFrame:
    # The set of symbols may be large, whatever the planner takes it for, and is never broadcast.
    rows = requests.join(sets["symbol_id"].hint("merge"), "symbol_id", "left").join(bounds, "held_by", "left")
    for c in ("exchange_id", "market_type"):
        rows = rows.join(sets[c].withColumn(f"has_{c}", F.lit(True)), ["held_by", c], "left")
    inside = ((F.col("start_ms") == 0) | (F.col("time_ms") >= F.col("start_ms"))) & ((F.col("end_ms") == 0) | (F.col("time_ms") < F.col("end_ms")))
    served = inside & F.col("has_exchange_id") & F.col("has_market_type")
    best = rows.groupBy("request_id").agg(F.min(F.when(served, F.struct("priority", "held_key")))["held_key"].alias(key))
    if strict:
        best = best.withColumn(key, F.coalesce(F.col(key), F.raise_error(F.lit("no store serves a request")).cast(bounds.schema["held_key"].dataType)))
    return best


def erase(rows: DataFrame, marked: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows without those whose `on` columns are in marked."""
    return rows.join(marked.select(*on).distinct(), [*on], "left_anti")


def erase_by_metadata(rows: DataFrame, meta: dict, segment_ms: int) -> DataFrame:
    """rows without the segments that touch the metadata's time range (0 is open), of its markets, exchanges and symbols."""
    start, end = meta.get("start_ms", 0), meta.get("end_ms", 0)
    segment = F.floor(F.col("time_ms") / segment_ms)
    hit = F.col("market_type").isin(*meta["market_types"]) & F.col("exchange_id").isin(*meta["exchange_ids"]) & F.col("symbol_id").isin(*meta["symbol_ids"])
    if start:
        hit &= segment >= start // segment_ms
    if end:
        hit &= segment <= (end - 1) // segment_ms
    return rows.where(~hit)


def erase_masked(rows: DataFrame, key: Column, mask: int, value: int) -> DataFrame:
    return rows.where(key.bitwiseAND(F.lit(mask).cast("long")) != F.lit(value).cast("long"))


def replace_segments(held: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """held, with all rows of a segment (its `on` columns) that new has rows of replaced by these."""
    return erase(held, new, on).unionByName(new)


def put_changed(held: DataFrame, new: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(what held becomes, the rows of new that differ from it): equal metadata isn't written again."""
    rest = [c for c in held.columns if c not in key]
    old = held.select(*key, F.struct(*rest).alias("old"))
    changed = new.join(old, [*key], "left").where(~F.col("old").eqNullSafe(F.struct(*(F.col(c) for c in rest)))).select(*held.columns)
    return erase(held, changed, key).unionByName(changed), changed


def pack_metadata(meta: dict) -> bytes:
    """Little-endian: flags, bounds, and each set with its size before it (symbols, exchanges, market types)."""
    out = struct.pack("<IQQ", meta["data_flags"], meta["start_ms"], meta["end_ms"])
    for name, form in (("symbol_ids", "H"), ("exchange_ids", "H"), ("market_types", "B")):
        out += struct.pack(f"<I{len(meta[name])}{form}", len(meta[name]), *meta[name])
    return out


def unpack_metadata(data: bytes) -> dict:
    flags, start, end = struct.unpack_from("<IQQ", data)
    meta, at = {"data_flags": flags, "start_ms": start, "end_ms": end}, struct.calcsize("<IQQ")
    for name, form in (("symbol_ids", "H"), ("exchange_ids", "H"), ("market_types", "B")):
        (n,) = struct.unpack_from("<I", data, at)
        meta[name] = list(struct.unpack_from(f"<{n}{form}", data, at + 4))
        at += 4 + n * struct.calcsize(form)
    return meta


def newest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("nth", n).where("nth = 1").drop("nth")
