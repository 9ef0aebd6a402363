"""Best-fit packing by swap-based local search (operator 10).

Documents become token sequences ending in the separator; only those longer than a sequence are cut, into full pieces after a
first, shorter one. Full pieces need no packing. The others are dealt into shards of about `shard_pieces`, by a hash; each shard is
placed by best fit in falling order of length, then improved by local search (at most 20,000 steps, each among the 64 bins next in room), in one task of bounded memory. Only lengths are
shuffled, never ids. A shard leaves about one bin underfull, so the loss against one global packing is about one sequence in
`shard_pieces` pieces.

Defined cases: a null text is empty and so is one separator; repeated rows are packed each; ties in length go by row order in the
shard; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import Scratch, slices
from marketloom.llm.tokens import bpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(count: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of count ids: full ones, but for the first."""
    first = count % room or room
    return [(0, first), *((s, room) for s in range(first, count, room))]


def tokenised(batches: Iterator[pa.RecordBatch], path: str, room: int, separator: int) -> Iterator[pa.RecordBatch]:
    encode, end = bpe(path).packed, np.array([separator], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    for batch in slices(batches):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encode(text or "") + end
            rows += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, room))]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class Bins:
    """Bins of one shard: members by length, free room, and an ordered list of the bins that have room."""

    def __init__(self, room: int):
        self.room, self.items, self.free, self.open = room, [], [], []

    def add(self) -> int:
        self.items.append([])
        self.free.append(self.room)
        return len(self.items) - 1

    def put(self, b: int, item: tuple[int, int]) -> None:
        self._change(b, item[0])
        self.items[b].append(item)

    def take(self, b: int, item: tuple[int, int]) -> None:
        self.items[b].remove(item)
        self._change(b, -item[0])

    def _change(self, b: int, n: int) -> None:
        if 0 < self.free[b] < self.room:
            del self.open[bisect_left(self.open, (self.free[b], b))]
        self.free[b] -= n
        if 0 < self.free[b] < self.room:
            insort(self.open, (self.free[b], b))

    def best(self, n: int, other_than: int = -1) -> int | None:
        """The bin with the least room that n fits in."""
        k = bisect_left(self.open, (n, -1))
        while k < len(self.open) and self.open[k][1] == other_than:
            k += 1
        return self.open[k][1] if k < len(self.open) else None


def best_fit(lengths: list[int], room: int) -> Bins:
    bins = Bins(room)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = bins.best(lengths[i])
        bins.put(bins.add() if b is None else b, (lengths[i], i))
    return bins


def best_pair(sizes: list[int], limit: int) -> tuple[int, int] | None:
    """Places of the two of the rising sizes with the largest sum up to the limit, found from both ends."""
    low, high, best = 0, bisect_left(sizes, limit) - 1, None
    while low < high:
        total = sizes[low] + sizes[high]
        if total <= limit:
            if best is None or total > sizes[best[0]] + sizes[best[1]]:
                best = (low, high)
            low += 1
        else:
            high -= 1
    return best


def exchange(bins: Bins, source: int, targets: list[int]) -> bool:
    """One step that raises the sum of squared fills by filling a target from source; source is no fuller than the target.

    Tried in this order: move an item, exchange one for one, exchange two for one. Of the exchanges with one target the one that
    fills it most is taken.
    """
    for item in sorted(bins.items[source], reverse=True):
        if (b := bins.best(item[0], source)) is not None and bins.free[b] <= bins.free[source]:
            bins.take(source, item)
            bins.put(b, item)
            return True
    own = sorted(bins.items[source])
    sizes = [x[0] for x in own]
    for target in targets:
        room = bins.free[target]
        if target == source or not room or room > bins.free[source]:
            continue
        most = None
        for out in bins.items[target]:
            k = bisect_left(sizes, out[0] + room + 1) - 1
            if k >= 0 and (gain := sizes[k] - out[0]) > 0 and (most is None or gain > most[0]):
                most = (gain, out, [own[k]])
            two = best_pair(sizes, out[0] + room)
            if two and (gain := sizes[two[0]] + sizes[two[1]] - out[0]) > 0 and (most is None or gain > most[0]):
                most = (gain, out, [own[k] for k in two])
        if most:
            _, out, into = most
            bins.take(target, out)
            for x in into:
                bins.take(source, x)
                bins.put(target, x)
            bins.put(source, out)
            return True
    return False


def local_search(bins: Bins, steps: int, width: int) -> None:
    """Empties the least filled bins one after another, into the `width` roomiest others at a step. A bin that no step improves is passed
    over until it changes. Ends when all are, when there are as few bins as the total needs, or after `steps` steps that changed something."""
    least = -(-sum(bins.room - f for f in bins.free) // bins.room)
    stuck: dict[int, int] = {}
    filled = sum(1 for x in bins.items if x)
    for _ in range(steps):
        while filled > least:
            source = next((b for f, b in reversed(bins.open) if stuck.get(b) != f), None)
            if source is None:
                return
            before = bins.free[source]
            at = bisect_left(bins.open, (before, source))
            near = bins.open[max(0, at - width) : at][::-1] + bins.open[at + 1 : at + 1 + width]
            if exchange(bins, source, [b for _, b in near]):
                break
            stuck[source] = before
        else:
            return
        filled = sum(1 for x in bins.items if x) if not bins.items[source] else filled


def pack(lengths: list[int], room: int, steps: int = 20_000, width: int = 64) -> list[tuple[int, int]]:
    """(bin, offset) of each length; bins are numbered from 0 without gaps."""
    bins = best_fit(lengths, room)
    local_search(bins, steps, width)
    out: list = [None] * len(lengths)
    for b, items in enumerate(x for x in bins.items if x):
        at = 0
        for n, i in items:
            out[i] = (b, at)
            at += n
    return out


def packed_shards(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition come shard by shard; one shard is held at a time."""

    def done(shard: int, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks()
        at = pack(t.column("length").to_pylist(), room)
        t = t.drop_columns(["shard"])
        t = t.append_column("sequence_id", pa.array([(shard << 32) + b for b, _ in at], pa.int64()))
        yield from t.append_column("offset", pa.array([o for _, o in at], pa.int64())).to_batches(max_chunksize=20_000)

    held, now = [], None
    for batch in batches:
        shards = np.asarray(batch.column("shard"))
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and shards[a] != now:
                yield from done(now, held)
                held = []
            now = int(shards[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield from done(now, held)


def best_fit_packing(
    docs: DataFrame, tokenizer: str, room: int = 2048, separator: int = 0, shard_pieces: int = 65_536, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.table(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .mapInArrow(lambda it: tokenised(it, tokenizer, room, separator), PIECES),
        "pieces",
    )
    short = F.col("length") < room
    shards = max(1, -(-pieces.where(short).count() // shard_pieces))
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).alias("shard")
    placed = (
        pieces.where(short).select("*", spread).repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "piece", "ids_crc32")
        .mapInArrow(lambda it: packed_shards(it, room), PIECES + ", sequence_id long, offset long")
    )
    full = pieces.where(~short).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)
