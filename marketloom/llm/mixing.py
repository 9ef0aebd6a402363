"""Mixing sources to target weights by iterative proportional fitting (operator 5).

A document weighs its tokens, counted by a tokenizer. Its topic is a cluster of hashed token counts; the clusters are fitted on all
documents: texts are tokenized once and their counts stored, and each step of the fit is a pass over these, of which the driver gets sums or one row.

Tokens are summed by cell (source, language, topic). Starting from the wanted share of each cell's tokens, every round scales the cells
to the target of each source, then language, then topic, and cuts a cell at the tokens that it has. A document is then drawn with
its cell's probability, wanted tokens over tokens at hand, by a hash of its id, so a draw repeats and needs no shuffle. Where cells
are cut, not every target can be met; `residuals` tells each marginal's target, expected share and drawn share.

Up to `most_cells` cells are raked on the driver, and the table of their probabilities, which is broadcast, has the same bound; more of
them are raked as a table, by the same rounds, and joined by shuffle.

Defined cases: a null category is a category of its own; a null text has one token, as an empty one, and is in the cluster that an empty text is in; a very long text is one
row of a batch and is counted whole; a null doc_id draws as the text "null"; repeated rows share one draw; targets without documents are
left out, and targets that nobody names keep their share; an empty table gives no rows; other columns pass untouched, whatever
their names (topic, tokens, probability and selected are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.common import Scratch, slices
from marketloom.llm.tokens import bpe

DIMENSIONS = ("source", "lang", "topic")
#: Target shares: each marginal's own shares to this power, which lifts the rare.
POWERS = {"source": 0.7, "lang": 0.5, "topic": 0.5}
#: Columns that token ids are hashed to.
WIDTH = 512
#: Profiles are summed in whole numbers of this fraction.
UNIT = 1 << 24
#: Profiles at hand at once, few enough for the processor's cache.
ROWS = 64
#: Logarithms of the counts that fit a byte; that of its last value isn't used.
LOGS = np.log1p(np.arange(256.0))


def hashed_counts(ids: np.ndarray) -> bytes:
    """Hashed token counts: a byte each, 255 for larger ones, which follow as 32-bit numbers in the order of their places."""
    counts = np.bincount((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(55)).astype(int), minlength=WIDTH)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u4").tobytes()


def profiles(packed: list[bytes]) -> np.ndarray:
    """A row each: logarithms of the counts, as a unit vector; all zeros without tokens."""
    places = np.frombuffer(b"".join([p[:WIDTH] for p in packed]), np.uint8).reshape(len(packed), WIDTH)
    x = LOGS[places]
    if large := b"".join([p[WIDTH:] for p in packed if len(p) > WIDTH]):
        x[places == 255] = np.log1p(np.frombuffer(large, "<u4").astype(float))
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    return x


def apart(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """What of profiles differs from the mean, as unit vectors."""
    x = x - mean
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    return x


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for batch in slices(batches, ROWS):
        yield batch.column(0).to_pylist()


def _sums(batches: Iterator[pa.RecordBatch], mean: np.ndarray | None, centres: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """own, place, value: sums by nearest centre (one without centres), in whole numbers, so that their order doesn't matter; place WIDTH counts rows."""
    total = np.zeros((1 if centres is None else len(centres), WIDTH + 1), np.int64)
    for packed in _packed(batches):
        x = profiles(packed)
        own = np.zeros(len(x), int)
        if centres is not None:
            x = apart(x, mean)
            own = (x @ centres.T).argmax(1)
        x *= UNIT
        members = (own == np.arange(len(total))[:, None]).astype(float)
        total[:, :WIDTH] += (members @ np.rint(x, out=x)).astype(np.int64)  # whole numbers below 2^53, so exact in any order
        total[:, WIDTH] += np.bincount(own, minlength=len(total))
    own, place = np.nonzero(total)
    yield pa.record_batch([pa.array(own, pa.int32()), pa.array(place, pa.int32()), pa.array(total[own, place])], ["own", "place", "value"])


def _farthest(batches: Iterator[pa.RecordBatch], mean: np.ndarray, centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """near, counts: of a task's rows the one whose nearest centre is farthest."""
    best = None
    for packed in _packed(batches):
        near = (apart(profiles(packed), mean) @ centres.T).max(1).round(9)
        least = near.min()
        row = (float(least), min(packed[k] for k in np.nonzero(near == least)[0]))
        best = row if best is None else min(best, row)
    if best:
        yield pa.record_batch([pa.array([best[0]]), pa.array([best[1]], pa.binary())], ["near", "counts"])


def fit_topics(counted: DataFrame, topics: int = 8, rounds: int = 20) -> tuple[np.ndarray, np.ndarray] | None:
    """The mean of all profiles, and the centres: spherical k-means over the column `counts` of all rows, begun with the farthest ones; None without rows."""
    counts = counted.select("counts")

    def sums(mean: np.ndarray | None, centres: np.ndarray | None) -> np.ndarray:
        found = counts.mapInArrow(lambda it: _sums(it, mean, centres), "own int, place int, value long").groupBy("own", "place").agg(F.sum("value").alias("value"))
        out = np.zeros((1 if centres is None else len(centres), WIDTH + 1), np.int64)
        for r in found.collect():  # at most topics * (WIDTH + 1) rows
            out[r.own, r.place] = r.value
        return out

    first = counts.agg(F.min(F.struct(F.xxhash64("counts").alias("hash"), "counts")).alias("least")).first().least
    if first is None:
        return None
    whole = sums(None, None)[0]
    mean = whole[:WIDTH] / (UNIT * whole[WIDTH])
    chosen = [bytes(first.counts)]
    while len(chosen) < topics:
        centres = apart(profiles(chosen), mean)
        found = counts.mapInArrow(lambda it, c=centres: _farthest(it, mean, c), "near double, counts binary").agg(F.min(F.struct("near", "counts")).alias("least")).first().least
        if bytes(found.counts) in chosen:
            break
        chosen.append(bytes(found.counts))
    centres, before = apart(profiles(chosen), mean), None
    for _ in range(rounds):
        now = sums(mean, centres)
        if before is not None and (now == before).all():
            break
        before, moved = now, now[:, :WIDTH] / UNIT
        centres = np.where(now[:, WIDTH:] > 0, moved / np.maximum(np.linalg.norm(moved, axis=1), 1e-12)[:, None], centres)
    return mean, centres


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    b = bpe(path)
    for batch in slices(batches):
        tokens, counts = [], []
        for text in batch.column(3).to_pylist():
            ids = np.frombuffer(b.packed(text), "<u4")
            tokens.append(max(len(ids), 1))
            counts.append(hashed_counts(ids))
        yield pa.record_batch([*batch.columns[:3], pa.array(tokens, pa.int64()), pa.array(counts, pa.binary())], ["row", "source", "lang", "tokens", "counts"])


def _assigned(batches: Iterator[pa.RecordBatch], fitted: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        own = (apart(profiles(batch.column(4).to_pylist()), fitted[0]) @ fitted[1].T).argmax(1)
        yield pa.record_batch([*batch.columns[:3], pa.array([f"topic-{k}" for k in own], pa.string()), batch.column(3)], ["row", "source", "lang", "topic", "tokens"])


def weigh(docs: DataFrame, tokenizer: str, keep: list[str], scratch: Scratch, topics: int = 8) -> DataFrame:
    """row (the columns `keep`), source, lang, topic, tokens of each document; columns of docs stay in their struct, so no names clash."""
    rows = docs.select(F.struct(*keep).alias("row"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    names = [T.StructField(d, T.StringType()) for d in DIMENSIONS]
    made = T.StructType([rows.schema["row"], *names[:2], T.StructField("tokens", T.LongType()), T.StructField("counts", T.BinaryType())])
    counted = scratch.table(rows.mapInArrow(lambda it: _counted(it, tokenizer), made), "counted")
    fitted = fit_topics(counted, topics)
    out = T.StructType([rows.schema["row"], *names, T.StructField("tokens", T.LongType())])
    weighed = scratch.table(counted.mapInArrow(lambda it: _assigned(it, fitted), out), "weighed")
    scratch.drop("counted")
    return weighed


def draw(id_col: str = "doc_id", seed: str = "mix") -> Column:
    """A number in [0, 1) from the id's hash."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def rake(cells: list[tuple], tokens: np.ndarray, share: float, targets: dict[str, dict] | None, rounds: int) -> np.ndarray:
    """Wanted tokens of each cell. targets: for a dimension, shares by category; by default POWERS."""
    x = tokens * share
    total = x.sum()
    codes, goals = {}, {}
    for k, d in enumerate(DIMENSIONS):
        names, codes[d] = np.unique(np.array([repr(c[k]) for c in cells]), return_inverse=True)
        own = np.bincount(codes[d], tokens, len(names)) / tokens.sum()
        if targets is None or d not in targets:
            goal = own ** POWERS[d] if targets is None else own
        else:
            stated = {repr(v): w for v, w in targets[d].items()}
            goal = np.array([stated.get(n, o) for n, o in zip(names, own, strict=True)], float)
        goals[d] = total * goal / goal.sum()
    for _ in range(rounds):
        for d in DIMENSIONS:
            now = np.bincount(codes[d], x, len(goals[d]))
            x = x * np.divide(goals[d], now, out=np.zeros_like(now), where=now > 0)[codes[d]]
        x = np.minimum(x, tokens)
    return x


def rake_table(cells: DataFrame, share: float, targets: dict[str, dict] | None, rounds: int, scratch: Scratch) -> DataFrame:
    """`rake` for any number of cells: source, lang, topic, n, x. Every scaling is a partial sum and a join by one category."""
    spark, null = cells.sparkSession, lambda d: F.col(d).eqNullSafe(F.col("of"))
    all_ = cells.agg(F.sum("n")).first()[0] or 0.0
    for d in DIMENSIONS:
        own = cells.groupBy(F.col(d).alias("of")).agg((F.sum("n") / all_).alias("own"))
        if targets is None:
            own = own.withColumn("goal", F.pow("own", F.lit(POWERS[d])))
        elif d in targets:
            stated = spark.createDataFrame([(v, float(w)) for v, w in targets[d].items()], "stated string, w double")
            own = own.join(stated, F.col("of").eqNullSafe(F.col("stated")), "left").withColumn("goal", F.coalesce("w", "own"))
        else:
            own = own.withColumn("goal", F.col("own"))
        own = scratch.table(own.select("of", "goal"), f"goals-{d}")
        part = all_ * share / (own.agg(F.sum("goal")).first()[0] or 1.0)
        cells = cells.join(own, null(d)).drop("of").withColumnRenamed("goal", f"t_{d}").withColumn(f"t_{d}", F.col(f"t_{d}") * part)
    now = scratch.table(cells.withColumn("x", F.col("n") * share), "raked-0")
    for k in range(1, rounds + 1):
        for d in DIMENSIONS:
            sums = now.groupBy(F.col(d).alias("of")).agg(F.sum("x").alias("now"))
            scaled = F.when(F.col("now") > 0, F.col("x") * F.col(f"t_{d}") / F.col("now")).otherwise(0.0)
            now = now.join(sums, null(d)).withColumn("x", scaled).drop("of", "now")
        now = scratch.table(now.withColumn("x", F.least("x", "n")), f"raked-{k}")
        scratch.drop(f"raked-{k - 1}")
    return now.select(*DIMENSIONS, "n", "x")


def mix(
    docs: DataFrame, tokenizer: str, share: float = 0.5, targets: dict[str, dict] | None = None, rounds: int = 20, most_cells: int = 200_000,
    topics: int = 8, keep: list[str] | None = None,
) -> DataFrame:
    """The columns `keep` of docs (by default all), then source and language as raked if they aren't among them, topic, tokens, probability and selected."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    made = ("topic", "tokens", "probability", "selected")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    rows = weigh(docs, tokenizer, keep, scratch, topics)
    cells = scratch.table(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("n")), "cells")
    if cells.count() > most_cells:
        table = scratch.table(rake_table(cells, share, targets, rounds, scratch), "raked")
    else:
        found = sorted(cells.collect(), key=repr)
        n = np.array([r.n for r in found])
        wanted = rake([(r.source, r.lang, r.topic) for r in found], n, share, targets, rounds) if found else n
        table = spark.createDataFrame([(r.source, r.lang, r.topic, r.n, float(x)) for r, x in zip(found, wanted, strict=True)], "source string, lang string, topic string, n double, x double")
        table = F.broadcast(table)
    cell = table.select(F.struct(*DIMENSIONS).alias("cell"), (F.col("x") / F.col("n")).alias("probability"))
    same = [F.col(f"cell.{d}").eqNullSafe(F.col(d)) for d in DIMENSIONS]
    out = rows.join(cell, same, "left").withColumn("selected", draw("row.doc_id") < F.col("probability"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in keep), *made)


def residuals(mixed: DataFrame, share: float = 0.5, targets: dict[str, dict] | None = None) -> DataFrame:
    """dimension, category, target, expected, drawn: shares of tokens, of a mix that keeps source and lang; one row a category."""
    out = None
    all_ = mixed.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability")), F.sum(F.when(F.col("selected"), F.col("tokens")))).first()
    for d in DIMENSIONS:
        parts = mixed.groupBy(F.col(d).alias("category")).agg(
            (F.sum("tokens") / (all_[0] or 1)).alias("own"), (F.sum(F.col("tokens") * F.col("probability")) / (all_[1] or 1)).alias("expected"),
            (F.coalesce(F.sum(F.when(F.col("selected"), F.col("tokens"))), F.lit(0)) / (all_[2] or 1)).alias("drawn"),
        )
        if targets is None:
            goal = F.pow("own", F.lit(POWERS[d]))
        else:
            goal = F.col("own")
            for v, w in targets.get(d, {}).items():
                goal = F.when(F.col("category").eqNullSafe(F.lit(v)), float(w)).otherwise(goal)
        parts = parts.withColumn("goal", goal)
        total = parts.agg(F.sum("goal")).first()[0] or 1.0
        parts = parts.select(F.lit(d).alias("dimension"), "category", (F.col("goal") / total).alias("target"), "expected", "drawn")
        out = parts if out is None else out.unionByName(parts)
    return out


def keep_mixed(docs: DataFrame, tokenizer: str, **settings) -> DataFrame:
    """The drawn documents, with the columns of docs."""
    spare = docs.select(F.struct("*").alias("row"), "doc_id", "source", "lang", "text")
    drawn = mix(spare, tokenizer, keep=["row", "doc_id"], **settings).where("selected")
    return drawn.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
