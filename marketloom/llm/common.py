"""What the operators share: inputs, the shared scratch folder, Arrow streaming, connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one slice when an Arrow batch is walked in Python; keeps the Python copies small for long texts.
SLICE_ROWS = 256


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it, whatever the driver's working folder is."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir. Set to a temporary folder only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="loom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """Parquet tables and files under one fresh folder of the shared folder; they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        importable(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loom/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns a DataFrame that reads it; its size is then known to the planner."""
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def free(self) -> None:
        """Lets Spark delete shuffle files of finished steps now; it does when the driver's collector finds their plans unused."""
        self.spark.range(1, numPartitions=1).collect()  # listeners hold the last query, and so its shuffle files, until another one ends
        gc.collect()
        self.spark._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with b < a; again such edges."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    large = (
        both.join(least, "a").where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        .where("a <> b").distinct()
    )
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("a", F.col("m").alias("b"))
    small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.unionByName(small).where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: (a, b) of any orderable type, in any order, with repeats and loops. Returns (node, component) for every node of a
    proper edge; component is its smallest reachable node. Each step is written to the shared folder, so lineage stays short.
    Stars are aggregated by partial minima; the join back to a hot centre has one row a key on one side, so it can be split.
    """
    now = scratch.table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"
    )
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before, k = now.agg(mark).first(), 0
    while before[0][0]:
        k += 1
        now = scratch.table(stars(now), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        after = now.agg(mark).first()
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
