"""MinHash near-duplicates: one-permutation hashing, optimal densification, bands, star-shaped candidates (operator 8).

1. Each document's distinct word shingles are hashed to 64 bits. Documents of one shingle set count once from here on, by their
   smallest id.
2. One permutation, cut into equal bins, gives the signature; an empty bin borrows from a bin that a hash of its own and the try
   picks, until one is found that isn't empty. Bands of `rows` bins make bucket keys; their number is such that a pair at the
   threshold shares no bucket with a chance of `miss` at most.
3. In each bucket all members are paired with the smallest one only: a star, as many pairs as members. Exact Jaccard
   similarity on the full sets confirms links, and their connected components follow.
4. A star can miss a link between two members that aren't like its centre. So the buckets whose members are still in several
   components are searched exactly: their sets meet in tasks of bounded size (a large bucket is cut into blocks, and each two blocks
   meet), each of which returns at most one edge a member. A bucket whose members are all in one component has nothing left to find.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. With fewer words than a shingle has, the whole sequence is the one shingle.

Defined cases: a null or blank text has no shingle and is linked with nothing; equal texts and repeated rows are linked; a null doc_id
keeps its row, kept, with a null component; rows of one doc_id with different texts are one document that has the links of each; an empty
table gives no rows; other columns are ignored; a text of any length is taken whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import Scratch, components, slices

#: Fixed values of the hash: a random number for each byte, an odd base and its inverse, and a mixing function's constants.
_BYTES = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C1B
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse to the powers 0 to n, modulo 2^64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(2 * n + 1, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's words begin (one more at the end)."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\x20".join([b"", *raw, b""]).lower(), np.uint8)
    white = _WHITE[data]
    starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum([1, *(len(x) + 1 for x in raw)])
    return hashes, np.searchsorted(starts, begins)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, at = word_hashes(texts)
    n = len(h) - words + 1
    joint = np.zeros(max(n, 0), np.uint64)
    for k in range(words):
        joint = mixed(joint + h[k : k + n] + np.uint64(k)) if n > 0 else joint
    out = []
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if z - a >= words:
            out.append(np.unique(joint[a : z - words + 1]))
        elif z > a:
            out.append(np.frombuffer(hashlib.blake2b(h[a:z].tobytes(), digest_size=8).digest(), np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Signatures:
    """Bucket keys of a sorted shingle set."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        self.bands, self.rows, self.k = bands, rows, bands * rows
        self.edges = np.array([-(-(j << 64) // self.k) for j in range(self.k)], np.uint64)
        self.tries = np.random.default_rng(seed).integers(0, self.k, (64 * self.k, self.k))

    def bins(self, s: np.ndarray) -> np.ndarray:
        first = np.append(np.searchsorted(s, self.edges), len(s))
        full = first[:-1] < first[1:]
        values = np.zeros(self.k, np.uint64)
        values[full] = s[first[:-1][full]]
        if full.sum() == 1:
            values[:] = values[full]
            return values
        empty = np.flatnonzero(~full)
        for tried in self.tries:
            if not len(empty):
                return values
            source = tried[empty]
            hit = full[source]
            values[empty[hit]] = values[source[hit]]
            empty = empty[~hit]
        values[empty] = s[0]
        return values

    def keys(self, s: np.ndarray) -> np.ndarray:
        v = self.bins(s).reshape(self.bands, self.rows)
        h = np.arange(self.bands, dtype=np.uint64)
        for k in range(self.rows):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + v[:, k])
        return h.view(np.int64)


def band_count(threshold: float, rows: int, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def _signed(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    made = Signatures(bands, rows)
    for batch in slices(batches):
        sets = shingle_sets([t or "" for t in batch.column(1).to_pylist()], words)
        marks = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets])
        sizes = np.array([len(s) for s in sets])
        keys = [made.keys(s) for s in sets if len(s)]
        offsets = np.concatenate(([0], np.cumsum((sizes > 0) * bands))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), lists], ["doc_id", "n_shingles", "hi", "lo", "keys"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = shingle_sets([t or "" for t in batch.column(1).to_pylist()], words)
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
        yield pa.record_batch([batch.column(0), lists], ["node", "shingles"])


def linked(members: pa.Table, percent: int) -> pa.Table:
    """Edges that join the components of a bucket's members (columns node, component, shingles), by exact similarity of any two."""
    names, labels = members.column("node").to_pylist(), members.column("component").to_pylist()
    lists = members.column("shingles").combine_chunks()
    sizes = np.asarray(lists.value_lengths()).astype(np.int64)
    values, owner = np.asarray(lists.flatten()), np.repeat(np.arange(len(names)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.searchsorted(values, values, "left")
    last = np.searchsorted(values, values, "right")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    begins = np.concatenate(([0], np.cumsum(sizes)))
    _, label = np.unique(np.array(labels), return_inverse=True)
    rest = np.flatnonzero(label != np.bincount(label).argmax())  # any link between two components has an end outside the largest
    edges = []
    for i in rest.tolist():
        if (label == label[0]).all():
            break
        places = back[begins[i] : begins[i + 1]]
        a, n = first[places], last[places] - first[places]
        hits = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        common = np.bincount(owner[hits], minlength=len(names))
        good = (label != label[i]) & (100 * common >= percent * (sizes + sizes[i] - common))
        for j in np.flatnonzero(good).tolist():
            if label[j] != label[i]:
                edges.append((names[i], names[j]))
                label[label == label[j]] = label[i]
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 5, miss: float = 1e-5, block_shingles: int = 1_000_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included), kept (doc_id = component_id)."""
    scratch = Scratch(docs.sparkSession, "neardup")
    bands = band_count(percent / 100, rows, miss)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.table(docs.mapInArrow(lambda it: _signed(it, words, bands, rows), "doc_id long, n_shingles long, hi long, lo long, keys array<long>"), "signed")
    some = signed.where("doc_id IS NOT NULL AND n_shingles > 0")

    # One node a distinct shingle set: its smallest document.
    groups = some.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
    shared = scratch.table(groups.where("n > 1").select("hi", "lo", "node"), "shared")
    nodes = some.join(shared, ["hi", "lo"], "left").withColumn("node", F.coalesce("node", "doc_id"))
    first = nodes.where("doc_id = node").select("node", "n_shingles", F.posexplode("keys").alias("band", "key"))
    first = scratch.table(first, "bands")
    buckets = first.groupBy("band", "key").agg(F.min("node").alias("centre"), F.max("node").alias("other")).where("centre < other")
    members = scratch.table(first.join(buckets.drop("other"), ["band", "key"]).distinct(), "members")
    scratch.drop("bands")

    needed = scratch.table(members.select("node").distinct(), "needed")
    sets = scratch.table(
        docs.join(needed, docs.doc_id == needed.node, "left_semi").mapInArrow(lambda it: _sets(it, words), "node long, shingles array<long>"), "sets"
    )
    pairs = members.where("node <> centre").select("node", "centre").distinct()
    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("centre"), F.col("shingles").alias("others")), "centre")
    common, size = F.size(F.array_intersect("shingles", "others")), F.size("shingles") + F.size("others")
    good = both.withColumn("common", common).where(100 * F.col("common") >= percent * (size - F.col("common")))
    stars = scratch.table(good.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "stars")
    found = scratch.table(components(stars, scratch, "first"), "found")

    # Buckets that still hold several components; of those with equal members, one.
    inside = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = (
        inside.groupBy("band", "key")
        .agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.sum("n_shingles").alias("total"),
             F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"))
        .where("n > 2 AND low < high").groupBy("n", "mark").agg(F.min(F.struct("band", "key")).alias("at"), F.first("total").alias("total"))
        .select("at.band", "at.key", F.ceil(F.col("total") / block_shingles).cast("int").alias("blocks"))
    )
    several = scratch.table(several, "several")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rest = inside.join(several, ["band", "key"]).withColumn("own", own)
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("band", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "component")
    edges = (
        rest.join(sets, "node").groupBy("band", "key", "p", "q")
        .applyInArrow(lambda table: linked(table, percent), "a long, b long")
    )
    more = scratch.table(edges.distinct(), "more")
    scratch.drop("sets", "members")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), scratch, "second")
    labels = found.withColumnsRenamed({"node": "root", "component": "reached"})
    out = signed.select("doc_id", "n_shingles", "hi", "lo").join(shared, ["hi", "lo"], "left")
    root = F.when(F.col("n_shingles") > 0, F.coalesce("node", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", root.alias("root")).join(labels, "root", "left")
    reached = F.when(F.col("doc_id").isNotNull(), F.coalesce("reached", "root"))
    return out.select("doc_id", "n_shingles", reached.alias("component_id"), F.coalesce(F.col("doc_id") == reached, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The document of smallest id of each component, with the columns of docs."""
    gone = near_duplicates(docs, words, percent).where("NOT kept").select(F.col("doc_id").alias("gone"))
    gone = Scratch(docs.sparkSession, "neardup-gone").table(gone.distinct(), "gone")
    return docs.join(gone, docs.doc_id == gone.gone, "left_anti").select(*docs.columns)
