"""Approximate nearest neighbours by cross-polytope hashing (operator 2).

A table turns a vector by three rounds of random signs and a fast Hadamard transform; its bucket is the signed axis nearest to the
result. A query probes, in each table, the buckets of the axes nearest to it. The rows and probes of a bucket meet in one group, a block
product in double precision ranks them, and the nearest of all groups are taken by exact scores of the original vectors.

Nearness is the inner product. A bucket depends on a vector's direction alone, so neither one long vector nor uneven norms change how
much of the table is looked at; lengths count in the scores.

How many buckets a query probes is measured: the true neighbours of `sample` queries, found by brute force against every row, tell how
many probes reach the share `recall` of them. Clustered vectors need few; where a neighbour is barely nearer than the rest, as in
vectors without clusters, it takes about half of all rows. Where one axis would have over `part_rows` rows in the mean, a bucket is the pair of axes of two turns, so the number of buckets grows with the
table. Both hold at every size: no table is searched in another way for being small.

A bucket of many rows is split by hash into parts of about `part_rows`, each of which all its probes visit, so no group is cut and
none outgrows a task. Of equal vectors only the k + 1 of smallest id can be in any answer; only these are indexed, which loses
nothing. Queries with fewer than k answers, where more exist, search again with every bucket of one table, which is exact.

Defined cases: vectors null, empty, zero, or with null or non-finite components take no part; vectors of different dimensions are never
compared; ties go to the smaller id; rows of one id are one candidate, with its best score; repeated query ids search as the first of
their vectors in array order; a null id takes no part; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import Scratch, slices

GROUPED = "dim int, tab int, bucket int, part int, kind int, id long, vector binary"
ROUNDS = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, m = x.shape
    h = 1
    while h < m:
        y = x.reshape(n, m // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, m)
        h *= 2
    return x / np.sqrt(m)


def axes(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Nearness of each row to every signed axis (2 m columns: +0, -0, +1, ...) after the table's turn."""
    n, d = x.shape
    m = 1 << max(1, (d - 1).bit_length())
    y = np.zeros((n, m))
    y[:, :d] = x
    rng = np.random.default_rng([seed, table, m])
    for signs in rng.choice([-1.0, 1.0], (ROUNDS, m)):
        y = hadamard(y * signs)
    return np.stack((y, -y), 2).reshape(n, 2 * m)


def nearness(x: np.ndarray, table: int, seed: int, hashes: int) -> np.ndarray:
    """Nearness of each row to every bucket of the table: to each axis, or to each pair of axes of two turns."""
    if hashes == 1:
        return axes(x, table, seed)
    one, two = axes(x, table, seed), axes(x, table, seed + 1)
    return (one[:, :, None] + two[:, None, :]).reshape(len(x), -1)


def bucket_of(x: np.ndarray, table: int, seed: int, hashes: int) -> np.ndarray:
    one = axes(x, table, seed)
    return one.argmax(1) if hashes == 1 else one.argmax(1) * one.shape[1] + axes(x, table, seed + 1).argmax(1)


def by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, matrix) of a batch whose second column holds lists without nulls."""
    lists = batch.column(1)
    sizes = np.asarray(lists.value_lengths())
    values, starts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, values[starts[rows][:, None] + np.arange(d)]


def _hashed(batches: Iterator[pa.RecordBatch], tables: int, probes: int, seed: int, parts: dict | None, kind: int, hashes: int) -> Iterator[pa.RecordBatch]:
    """A row for each table (kind 0, index) or for each probe and part (kind 1, query); parts is None while buckets are counted."""
    kinds = [pa.int32()] * 5 + [pa.int64(), pa.binary()]
    names = ["dim", "tab", "bucket", "part", "kind", "id", "vector"]
    for batch in slices(batches, 1024 if hashes == 1 or kind == 0 else 64):
        ids = np.asarray(batch.column(0))
        for d, rows, x in by_dimension(batch):
            wide = x.astype(np.float64)
            packed = [v.tobytes() for v in x]
            for t in range(tables):
                if kind == 0:
                    buckets = bucket_of(wide, t, seed, hashes)
                    part = np.zeros(len(x), int) if parts is None else (ids[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(int) % np.array([parts[d, t, b] for b in buckets.tolist()])
                    which = np.arange(len(x))
                else:
                    near = nearness(wide, t, seed, hashes)
                    take = min(probes, near.shape[1])
                    found = np.argpartition(-near, take - 1, axis=1)[:, :take] if take < near.shape[1] else np.tile(np.arange(take), (len(x), 1))
                    hits = [(i, b, p) for i, line in enumerate(found.tolist()) for b in line for p in range(parts.get((d, t, b), 0))]
                    which, buckets, part = np.array(hits, int).reshape(-1, 3).T
                same = lambda v: np.full(len(which), v)
                vectors = pa.array([None] * len(which) if parts is None else [packed[i] for i in which.tolist()], pa.binary())
                data = [same(d), same(t), buckets, part, same(kind), ids[rows][which]]
                yield pa.record_batch([*(pa.array(a, k) for a, k in zip(data, kinds, strict=False)), vectors], names)


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> list[np.ndarray]:
    """The k best (query, id, score) of each query, each pair once; ties to the smaller id."""
    q, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((-s, v, q))
    q, v, s = q[order], v[order], s[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
    q, v, s = q[new], v[new], s[new]
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return [q[keep], v[keep], s[keep]]


def _lists(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    """One row a query, with its answers as two lists."""
    starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    offsets = pa.array(np.append(starts, len(q)).astype(np.int32))
    return pa.record_batch([pa.array(q[starts]), pa.ListArray.from_arrays(offsets, pa.array(v)), pa.ListArray.from_arrays(offsets, pa.array(s))], ["query_id", "ids", "scores"])


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by query; the best k of all lists of a query, ranked. One slice and one query's answers are held."""
    held: list = []

    def done(found: list) -> pa.RecordBatch:
        q, v, s = _best(found, k)
        rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
        return pa.record_batch([pa.array(q), pa.array(rank.astype(np.int32)), pa.array(v), pa.array(s)], ["query_id", "rank", "vec_id", "score"])

    for batch in slices(batches, 512):
        sizes = np.asarray(batch.column(1).value_lengths())
        q = np.repeat(np.asarray(batch.column(0)), sizes)
        v, s = np.asarray(batch.column(1).flatten()), np.asarray(batch.column(2).flatten())
        last = np.searchsorted(q, q[-1])
        if last or held and held[-1][0][0] != q[-1]:
            yield done([*held, (q[:last], v[:last], s[:last])])
            held = []
        held = [tuple(_best([*held, (q[last:], v[last:], s[last:])], k))]
    if held:
        yield done(held)


def ranked(queries: np.ndarray, own: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k (query, id, score) of a block, and those that tie with the last up to rounding; scores are summed in one fixed order."""
    rough = queries @ block.T
    rough[own[:, None] == ids[None, :]] = -np.inf
    if rough.shape[1] > k:
        least = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
        least = least - 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
    else:
        least = np.full(len(queries), -np.inf)
    i, j = np.nonzero((rough >= least[:, None]) & np.isfinite(rough))
    return own[i], ids[j], (queries[i] * block[j]).sum(1)


def _searched(batches: Iterator[pa.RecordBatch], k: int, four: bool, flush: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group, index rows first. Holds one group's index rows and a bounded list of answers."""
    found, held, now, ids, vectors, block = [], 0, None, [], [], None
    kind_of = np.float32 if four else np.float64

    def out() -> pa.RecordBatch:
        return _lists(*_best(found, k))

    for batch in slices(batches, 512):
        keys = np.stack([np.asarray(batch.column(c)) for c in range(5)], 1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        names = np.asarray(batch.column(5))
        for a, z in zip(edges, edges[1:]):
            group, kind = tuple(keys[a, :4].tolist()), keys[a, 4]
            if group != now:
                now, ids, vectors, block = group, [], [], None
            x = np.frombuffer(b"".join(batch.column(6).slice(a, z - a).to_pylist()), kind_of).reshape(z - a, group[0]).astype(np.float64)
            if kind == 0:
                ids.append(names[a:z])
                vectors.append(x)
            elif ids:
                if block is None:
                    block, members = np.concatenate(vectors), np.concatenate(ids)
                found.append(ranked(x, names[a:z], block, members, k))
                held += len(found[-1][0])
        if held > flush:
            found = [tuple(_best(found, k))]
            held = len(found[0][0])
            if held > flush // 2:
                yield out()
                found, held = [], 0
    if found:
        yield out()


def _scanned(batches: Iterator[pa.RecordBatch], asked: dict, k: int) -> Iterator[pa.RecordBatch]:
    """The best k of each slice's rows for each of the few queries of `asked`, by dimension."""
    for batch in slices(batches, 4096):
        ids = np.asarray(batch.column(0))
        for d, rows, x in by_dimension(batch):
            if d in asked:
                own, queries = asked[d]
                yield _lists(*_best([ranked(queries, own, x.astype(np.float64), ids[rows], k)], k))


def measured_probes(index: DataFrame, asked: DataFrame, k: int, tables: int, seed: int, hashes: int, sample: int, recall: float) -> int:
    """The least number of probes a table that reaches that share of the true neighbours of `sample` queries, those of the smallest hashes of their ids."""
    some = asked.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    by = {d: [r for r in some if len(r["vector"]) == d] for d in {len(r["vector"]) for r in some}}
    by = {d: (np.array([r["id"] for r in rows]), np.array([r["vector"] for r in rows], np.float64)) for d, rows in by.items()}
    scanned = index.mapInArrow(lambda it: _scanned(it, by, k), "query_id long, ids array<long>, scores array<double>")
    merged = scanned.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(lambda it: _merged(it, k), "query_id long, rank int, vec_id long, score double")
    true = merged.join(index, F.col("vec_id") == F.col("id")).select("query_id", "vector").collect()  # sample * k, but for ids of several vectors
    need = []
    for d, (own, queries) in by.items():
        place = {q: i for i, q in enumerate(own.tolist())}
        pairs = [(place[r["query_id"]], r["vector"]) for r in true if r["query_id"] in place and len(r["vector"]) == d]
        if pairs:
            q, least = np.array([i for i, _ in pairs]), None
            for t in range(tables):
                near = nearness(queries, t, seed, hashes)
                at = bucket_of(np.array([v for _, v in pairs], np.float64), t, seed, hashes)
                before = np.array([(near[i] > near[i, b]).sum() for i, b in zip(q, at)])
                least = before if least is None else np.minimum(least, before)
            need += least.tolist()
    return 1 + int(np.sort(need)[min(len(need) - 1, int(np.ceil(recall * len(need))))]) if need else 1


def nearest(
    table: DataFrame, queries: DataFrame | None = None, k: int = 20, tables: int = 6, probes: int | None = None, part_rows: int = 8192, seed: int = 7,
    id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 64, recall: float = 0.96, hashes: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query; queries: rows of the same form, by default all of the table.

    probes and hashes, where given, take the place of what is measured; more probes than there are buckets make the search exact.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "ann")
    four = "float" in dict(table.dtypes)[vector_col]

    def valid(df: DataFrame) -> DataFrame:
        v = F.col("vector")
        good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
        return rows.where("id IS NOT NULL AND vector IS NOT NULL").where(good & F.exists(v, lambda x: x != 0))

    rows = valid(table).distinct()  # a repeated row takes no other's place among its twins
    twin = Window.partitionBy("vector").orderBy("id")
    index = scratch.table(rows.withColumn("twin", F.row_number().over(twin)).where(F.col("twin") <= k + 1).drop("twin"), "index")
    asked = scratch.table(valid(table if queries is None else queries).groupBy("id").agg(F.min("vector").alias("vector")), "asked")
    if hashes is None:
        most = index.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
        buckets = 2 << max(1, ((most["d"] or 1) - 1).bit_length())
        hashes = 2 if most["n"] > buckets * part_rows and buckets <= 256 else 1
    if probes is None:
        probes = measured_probes(index, asked, k, tables, seed, hashes, sample, recall)
    hashed = lambda df, n, kind, parts, p, h: df.mapInArrow(lambda it: _hashed(it, n, p, seed, parts, kind, h), GROUPED)
    group = ["dim", "tab", "bucket", "part"]

    def search(asked: DataFrame, n: int, p: int, h: int) -> DataFrame:
        # One row a table and bucket: a few thousand, or half a million where buckets are pairs.
        sizes = hashed(index, n, 0, None, 0, h).groupBy("dim", "tab", "bucket").count().collect()
        parts = {(r["dim"], r["tab"], r["bucket"]): -(-r["count"] // part_rows) for r in sizes}
        both = hashed(index, n, 0, parts, 0, h).unionByName(hashed(asked, n, 1, parts, p, h))
        sorted_ = both.repartition(*group).sortWithinPartitions(*group, "kind", "id")
        found = sorted_.mapInArrow(lambda it: _searched(it, k, four, 400_000), "query_id long, ids array<long>, scores array<double>")
        by_query = found.repartition("query_id").sortWithinPartitions("query_id")
        return by_query.mapInArrow(lambda it: _merged(it, k), "query_id long, rank int, vec_id long, score double")

    first = scratch.table(search(asked, tables, probes, hashes), "found")
    fewer = asked.join(first.where(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti")
    if fewer.isEmpty():
        return first
    again = scratch.table(search(scratch.table(fewer, "fewer"), 1, 1 << 30, 1), "again")
    return first.join(again.select("query_id").distinct(), "query_id", "left_anti").unionByName(again)
