"""Column encodings as relations: rows (keys, pos, value) in, rows out.

A window is one array of values (one key), which is a storage segment and so of bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import fixedpoint


def zigzag(v: Column) -> Column:
    v = v.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(z: Column) -> Column:
    z = z.cast("long")
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1).cast("long"))))


def _order(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("pos")


def _so_far(keys: Sequence[str]):
    return _order(keys).rowsBetween(Window.unboundedPreceding, 0)


def delta(rows: DataFrame, keys: Sequence[str], initial: int = 0) -> DataFrame:
    return rows.withColumn("value", F.col("value") - F.coalesce(F.lag("value").over(_order(keys)), F.lit(initial).cast("long")))


def undelta(rows: DataFrame, keys: Sequence[str], initial: int = 0) -> DataFrame:
    return rows.withColumn("value", F.sum("value").over(_so_far(keys)) + F.lit(initial).cast("long"))


def delta_sorted(rows: DataFrame, keys: Sequence[str], initial: int = 0) -> DataFrame:
    """Differences of values that must not fall, nor begin under the base; else an error."""
    out = delta(rows, keys, initial)
    return out.withColumn("value", F.when(F.col("value") < 0, F.raise_error(F.lit("times fall")).cast("long")).otherwise(F.col("value")))


def delta_zigzag(rows: DataFrame, keys: Sequence[str], initial: int = 0) -> DataFrame:
    return delta(rows, keys, initial).withColumn("value", zigzag(F.col("value")))


def undelta_zigzag(rows: DataFrame, keys: Sequence[str], initial: int = 0) -> DataFrame:
    return undelta(rows.withColumn("value", unzigzag(F.col("value"))), keys, initial)


def price_delta(rows: DataFrame, keys: Sequence[str], digits: int, initial: float = 0.0) -> DataFrame:
    """Prices as scaled integers, their differences in zigzag form."""
    scaled = rows.withColumn("value", fixedpoint.to_fixed(F.col("value"), digits))
    return delta_zigzag(scaled, keys, round(initial * 10**digits))


def unprice_delta(rows: DataFrame, keys: Sequence[str], digits: int, initial: float = 0.0) -> DataFrame:
    out = undelta_zigzag(rows, keys, round(initial * 10**digits))
    return out.withColumn("value", fixedpoint.from_fixed(F.col("value"), digits))


def delta_chunked(rows: DataFrame, keys: Sequence[str], width: int, initial: int = 0) -> DataFrame:
    """Each value less the last one of the chunk before; positions count from 0."""
    last = F.lag("value", 1).over(_order(keys))
    chunk = F.floor(F.col("pos") / width)
    base = F.max(F.when(F.col("pos") % width == 0, F.coalesce(last, F.lit(initial).cast("long")))).over(Window.partitionBy(*keys, chunk))
    return rows.withColumn("value", zigzag(F.col("value") - base))


def undelta_chunked(rows: DataFrame, keys: Sequence[str], width: int, initial: int = 0) -> DataFrame:
    """A chunk's base is the sum of the last differences of the chunks before."""
    rows = rows.withColumn("value", unzigzag(F.col("value"))).withColumn("run chunk", F.floor(F.col("pos") / width))
    ends = rows.groupBy(*keys, "run chunk").agg(F.max_by("value", "pos").alias("run step"))
    w = Window.partitionBy(*keys).orderBy("run chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("run base", F.coalesce(F.sum("run step").over(w), F.lit(0).cast("long")) + F.lit(initial).cast("long"))
    return rows.join(ends.drop("run step"), [*keys, "run chunk"]).withColumn("value", F.col("value") + F.col("run base")).drop("run chunk", "run base")


def frequency_codes(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A code from 0 for each value: the most frequent first, of equals the smaller value."""
    counted = rows.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "value"))
    return counted.withColumn("code", (rank - 1).cast("long"))


def frequency_encode(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    codes = frequency_codes(rows, keys).drop("n")
    return rows.join(codes, [*keys, "value"]).drop("value").withColumnRenamed("code", "value")


def frequency_decode(rows: DataFrame, codes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    back = codes.select(*keys, F.col("code"), F.col("value").alias("decoded"))
    return rows.withColumnRenamed("value", "code").join(back, [*keys, "code"]).drop("code").withColumnRenamed("decoded", "value")


def zero_runs(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run-length code of zeros: n of them give 2n+1, another value v gives 2v. A zero right after another value is that value 0, not a run."""
    order, so_far = _order(keys), _so_far(keys)
    inside = (F.col("value") == 0) & (F.coalesce(F.lag("value").over(order), F.lit(0)) == 0)
    rows = rows.withColumn("run inside", inside)
    rows = rows.withColumn("run group", F.sum((~F.col("run inside")).cast("long")).over(so_far))
    out = rows.groupBy(*keys, "run group", "run inside").agg(F.min("pos").alias("run start"), F.count("*").alias("run n"), F.first("value").alias("run v"))
    code = F.when(F.col("run inside"), F.col("run n") * 2 + 1).otherwise(F.col("run v") * 2)
    out = out.withColumn("value", code)
    return out.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("run start")) - 1).cast("long").alias("pos"), "value")


def _spread(rows: DataFrame, keys: Sequence[str], value: Column, count: Column) -> DataFrame:
    """Each row `count` times, positions numbered anew."""
    rows = rows.withColumn("run item", value).withColumn("run times", count)
    before = F.coalesce(F.sum("run times").over(_order(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("run at", before)
    rows = rows.withColumn("run k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("run times") - 1)))
    return rows.select(*keys, (F.col("run at") + F.col("run k")).alias("pos"), F.col("run item").alias("value"))


def unzero_runs(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    run = F.col("value").bitwiseAND(F.lit(1).cast("long")) == 1
    half = F.shiftright("value", 1)
    return _spread(rows, keys, F.when(run, F.lit(0).cast("long")).otherwise(half), F.when(run, half).otherwise(F.lit(1).cast("long")))


def runs(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(pos, value, n) of each run of equal values."""
    order, so_far = _order(keys), _so_far(keys)
    new = F.coalesce(F.col("value") != F.lag("value").over(order), F.lit(True)).cast("long")
    rows = rows.withColumn("run new", new).withColumn("run group", F.sum("run new").over(so_far))
    out = rows.groupBy(*keys, "run group").agg(F.first("value").alias("value"), F.count("*").alias("n"))
    return out.select(*keys, (F.col("run group") - 1).alias("pos"), "value", "n")


def unruns(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _spread(rows, keys, F.col("value"), F.col("n"))


def run_lengths(rows: DataFrame, keys: Sequence[str], least: int = 3) -> DataFrame:
    """Runs of at least `least` stay runs; of shorter ones every value is a run of one."""
    got = runs(rows, keys)
    short = F.col("n") < least
    got = got.withColumn("run k", F.explode(F.sequence(F.lit(1).cast("long"), F.when(short, F.col("n")).otherwise(F.lit(1).cast("long")))))
    got = got.withColumn("n", F.when(short, F.lit(1).cast("long")).otherwise(F.col("n")))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "run k"))
    return got.select(*keys, (order - 1).cast("long").alias("pos"), "value", "n")


def value_runs(rows: DataFrame, keys: Sequence[str], value_bits: int = 32) -> DataFrame:
    """Runs as single numbers: the value in the low bits, one less than the run's length above them. An error if a value is wider."""
    got = runs(rows, keys)
    fits = (F.col("value") >= 0) & (F.col("value") < (1 << value_bits)) & (F.col("n") <= 1 << (62 - value_bits))
    code = F.shiftleft(F.col("n") - 1, value_bits).bitwiseOR(F.col("value"))
    return got.select(*keys, "pos", F.when(fits, code).otherwise(F.raise_error(F.lit("a value is too wide")).cast("long")).alias("value"))


def unvalue_runs(rows: DataFrame, keys: Sequence[str], value_bits: int = 32) -> DataFrame:
    low = F.col("value").bitwiseAND(F.lit((1 << value_bits) - 1).cast("long"))
    return _spread(rows, keys, low, F.shiftrightunsigned("value", value_bits) + 1)


def scale_volume(rows: DataFrame, digits: int, bits: int = 64) -> DataFrame:
    """Volumes as scaled integers; with 32 bits an error beyond them."""
    v = fixedpoint.to_fixed(F.col("value"), digits)
    fits = F.lit(True) if bits == 64 else (v >= 0) & (v < (1 << bits))
    return rows.withColumn("value", F.when(fits, v).otherwise(F.raise_error(F.lit("a volume is too large")).cast("long")))


def restore_volume(rows: DataFrame, digits: int) -> DataFrame:
    return rows.withColumn("value", fixedpoint.from_fixed(F.col("value"), digits))


def vbyte_bytes(values: np.ndarray) -> bytes:
    """Seven bits a byte, the lowest first; the top bit says that more follow."""
    out = bytearray()
    for v in values.astype(np.uint64).tolist():
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def vbyte_values(data: bytes) -> np.ndarray:
    out, v, shift = [], 0, 0
    for b in data:
        v |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(v)
            v = shift = 0
    return np.array(out, np.uint64).astype(np.int64)


def packed_bits(values: np.ndarray, width: int | None = None) -> bytes:
    """Blocks of 128 values: a byte of the block's width, then its values in so many bits each; a short last block has its count first."""
    out = [len(values).to_bytes(4, "little")]
    for a in range(0, len(values), 128):
        block = values[a : a + 128].astype(np.uint64)
        w = int(block.max()).bit_length() if width is None else width
        if w < 64 and (block >> np.uint64(w)).any():
            raise ValueError("a value is too wide")
        bits = (block[:, None] >> np.arange(w, dtype=np.uint64)) & np.uint64(1)
        out += [bytes([w]), np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()]
    return b"".join(out)


def unpacked_bits(data: bytes) -> np.ndarray:
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    for a in range(0, n, 128):
        count, w = min(128, n - a), data[at]
        size = -(-count * w // 8)
        bits = np.unpackbits(np.frombuffer(data[at + 1 : at + 1 + size], np.uint8), bitorder="little")[: count * w].reshape(count, w)
        out.append((bits.astype(np.uint64) << np.arange(w, dtype=np.uint64)).sum(1, dtype=np.uint64))
        at += 1 + size
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


ENCODERS = {"vbyte": (vbyte_bytes, vbyte_values), "bits": (packed_bits, unpacked_bits)}


def to_blob(rows: DataFrame, keys: Sequence[str], encoding: str) -> DataFrame:
    """keys, count, blob: each key's values, in order, in one of ENCODERS; Arrow batches, one segment a group."""
    encode = ENCODERS[encoding][0]

    def all_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(count=pdf["values"].map(len), blob=pdf["values"].map(lambda v: encode(np.asarray(v)))).drop(columns="values")

    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in keys)
    arrays = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("values"))
    return arrays.select(*keys, F.col("values.value").alias("values")).mapInPandas(all_, f"{schema}, count long, blob binary")


def from_blob(blobs: DataFrame, keys: Sequence[str], encoding: str) -> DataFrame:
    decode = ENCODERS[encoding][1]
    kinds = dict(blobs.dtypes)

    def all_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                v = decode(bytes(row["blob"]))
                yield pd.DataFrame({**{k: [row[k]] * len(v) for k in keys}, "pos": np.arange(len(v)), "value": v})

    return blobs.select(*keys, "blob").mapInPandas(all_, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", pos long, value long")
