"""Delta-maintained token counts (operator 7).

A ledger keeps additive totals of documents and tokens by source, language and tokenizer version. A batch of inserts, deletes and revised
counts becomes signed rows, summed by key, and is written to a folder of its own, which one rename, which fails where something is, puts in place under the batch's
id. A batch whose id is there already changes nothing, so a driver may send it again after any failure; a reader sees whole batches
only. `fold` writes the sum of what is committed as one snapshot, with the ids it covers, so totals stay cheap after many batches.

Defined cases: a null source or language is a key of its own; null counts are 0; keys whose totals came back to zero documents and tokens
are left out; repeated rows of a feed count each, as a feed states changes and not a state; an empty batch is committed and adds
nothing; an empty ledger gives no rows; other columns are ignored. Texts that are null are empty, and count 0 tokens.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import Scratch, slices
from marketloom.llm.tokens import bpe

KEY = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, docs long, tokens long"


def signed(feed: DataFrame) -> DataFrame:
    """feed: op (insert, delete, revise), source, lang, version, tokens, and for revise old_source, old_lang, old_tokens; as signed rows."""
    n, old = F.coalesce("tokens", F.lit(0)).cast("long"), F.coalesce("old_tokens", F.lit(0)).cast("long")
    one = F.lit(1).cast("long")
    row = lambda s, g, d, t: F.struct(s.alias("source"), g.alias("lang"), F.col("version").alias("version"), d.alias("docs"), t.alias("tokens"))
    plus = row(F.col("source"), F.col("lang"), one, n)
    rows = (
        F.when(F.col("op") == "insert", F.array(plus))
        .when(F.col("op") == "delete", F.array(row(F.col("source"), F.col("lang"), -one, -n)))
        .when(F.col("op") == "revise", F.array(row(F.col("old_source"), F.col("old_lang"), -one, -old), plus))
    )
    checked = F.coalesce(rows, F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null")))))
    return feed.select(F.inline(checked))


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for x in ("batches", "snapshots", "staged"):
            self._fs.mkdirs(self._path(f"{self.root}/{x}"))

    def _names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/{folder}")))

    def _place(self, staged: str, final: str) -> bool:
        """Renames a finished folder into place; the file system refuses where something is there. Says whether it did."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(self._path(self.root)).toUri(), conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(self._path(staged), self._path(final), options)
            return True
        except Py4JJavaError:
            if not self._fs.exists(self._path(final)):
                raise
            self._fs.delete(self._path(staged), True)
            return False

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """deltas: source, lang, version, docs, tokens, signed. False if the batch is there already, and then nothing is computed."""
        final = f"{self.root}/batches/{batch}"
        if self._fs.exists(self._path(final)) or batch in self._snapshot()[1]:
            return False
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        summed = deltas.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        summed.coalesce(1).write.parquet(staged)  # one row a key
        return self._place(staged, final)

    def _snapshot(self) -> tuple[str | None, set[str]]:
        names = self._names("snapshots")
        if not names:
            return None, set()
        place = f"{self.root}/snapshots/{names[-1]}"
        covered = self.spark.read.text(f"{place}/covered").first()[0]
        return f"{place}/totals", set(json.loads(covered))

    def _listed(self) -> tuple[list[str], str | None, set[str]]:
        """Batches that no snapshot covers, the newest snapshot's totals, and the ids it covers; of one moment, as batches are listed first."""
        batches = self._names("batches")
        place, covered = self._snapshot()
        return [b for b in batches if b not in covered], place, covered

    def _sums(self, batches: list[str], place: str | None) -> DataFrame:
        paths = [f"{self.root}/batches/{b}" for b in batches] + ([place] if place else [])
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        batches, place, _ = self._listed()
        return self._sums(batches, place)

    def fold(self) -> None:
        """Writes a snapshot of all that is committed when it begins; the batches it covers are deleted after it is in place."""
        batches, place, covered = self._listed()
        staged, n = f"{self.root}/staged/{uuid.uuid4().hex}", len(self._names("snapshots"))
        self._sums(batches, place).coalesce(1).write.parquet(f"{staged}/totals")
        self.spark.createDataFrame([(json.dumps(sorted(covered | set(batches))),)], "value string").coalesce(1).write.text(f"{staged}/covered")
        if self._place(staged, f"{self.root}/snapshots/{n:012d}"):
            for b in batches:
                self._fs.delete(self._path(f"{self.root}/batches/{b}"), True)


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    b = bpe(path)
    for batch in slices(batches):
        texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
        counts = [pa.array([len(b.packed(t)) // 4 for t in texts], pa.int64()), pa.array([len(t.split()) for t in texts], pa.int64())]
        yield pa.record_batch([*batch.columns[:-1], *counts], [*batch.schema.names[:-1], "bpe", "words"])


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, lang, digest (of the text), bpe and words (two counts of its tokens)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", "lang", F.md5(text.cast("binary")).alias("digest"), text.alias("text"))
    return rows.mapInArrow(lambda it: _counted(it, tokenizer), "doc_id long, source string, lang string, digest string, bpe long, words long")


def corpus_rollup(docs: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """A corpus' life in four batches, one of them sent twice: source, lang, version, docs, tokens.

    load: all documents under `version` and under words-1, which counts 4 tokens to 3 words. revise: words-1 is put right to one token a word.
    withdraw: of documents of equal text one stays, that of the smallest id, null ids last, ties by source and language; it is all withdrawn and
    the survivors put back, so no text's copies meet in a join. load again: no change.
    """
    scratch = Scratch(docs.sparkSession, "rollups")
    counted = scratch.table(count_tokens(docs, tokenizer), "counted")
    order = F.struct(F.col("doc_id").isNull().alias("none"), *(F.col(c) for c in ("doc_id", "source", "lang", "bpe", "words")))
    stay = counted.groupBy("digest").agg(F.min(order).alias("one")).select("one.*")
    none, guess = F.lit(None).cast("long"), F.floor(F.col("words") * 4 / 3).cast("long")

    def feed(rows: DataFrame, op: str, name: str, tokens, old=none) -> DataFrame:
        moved = [F.col(c).alias(f"old_{c}") for c in ("source", "lang")]
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(name).alias("version"), tokens.alias("tokens"), *moved, old.alias("old_tokens"))

    ledger = Ledger(docs.sparkSession, scratch.path("ledger"))
    load = signed(feed(counted, "insert", version, F.col("bpe")).unionByName(feed(counted, "insert", "words-1", guess)))
    ledger.commit("load", load)
    ledger.commit("revise", signed(feed(counted, "revise", "words-1", F.col("words"), guess)))
    both = [(version, F.col("bpe")), ("words-1", F.col("words"))]
    changes = [feed(rows, op, name, n) for rows, op in ((counted, "delete"), (stay, "insert")) for name, n in both]
    ledger.commit("withdraw", signed(reduce(DataFrame.unionByName, changes)))
    ledger.commit("load", load)
    ledger.fold()
    return ledger.totals()
