"""Key-value tables of unsigned 32-bit or 64-bit keys (64-bit ones as signed longs of the same bits), in folders by hash of the key."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key long, value binary, bucket int"


class KeyValue:
    """One table. A put rewrites the folders of its keys; a get reads the folders of its keys; a scan reads all."""

    def __init__(self, spark: SparkSession, root: str, bits: int = 64, buckets: int = 16):
        if bits not in (32, 64):
            raise ValueError("keys have 32 or 64 bits")
        self.spark, self.root, self.bits, self.buckets = spark, root.rstrip("/"), bits, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        if self.bits == 32:
            wide = (F.col("key") < 0) | (F.col("key") > (1 << 32) - 1)
            rows = rows.withColumn("key", F.when(wide, F.raise_error(F.lit("a key has over 32 bits")).cast("long")).otherwise(F.col("key")))
        return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))

    def scan(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """key, value, bucket, of all keys or of some folders."""
        paths = [f"{self.root}/bucket={b}" for b in (range(self.buckets) if buckets is None else buckets)]
        paths = [p for p in paths if self._fs.exists(self._path(p))]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", self.root).parquet(*paths)

    def put(self, rows: DataFrame) -> None:
        """rows: key, value, each key once. Keys that are there already take the new value."""
        new = self._bucketed(rows.select(F.col("key").cast("long").alias("key"), "value"))
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
        kept = self.scan(touched).join(new.select("key"), "key", "left_anti").select("key", "value", "bucket")
        staged = f"{self.root}/.staged-{uuid.uuid4().hex}"
        kept.unionByName(new).repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(staged)
        for b in touched:
            self._fs.delete(self._path(f"{self.root}/bucket={b}"), True)
            self._fs.rename(self._path(f"{staged}/bucket={b}"), self._path(f"{self.root}/bucket={b}"))
        self._fs.delete(self._path(staged), True)
        self.spark.catalog.refreshByPath(self.root)

    def get(self, keys: DataFrame) -> DataFrame:
        """key, value of the keys that are there."""
        wanted = self._bucketed(keys.select(F.col("key").cast("long").alias("key"))).distinct()
        return self.scan().join(wanted, ["bucket", "key"], "left_semi").select("key", "value")

    def get_one(self, key: int) -> bytes | None:
        one = self._bucketed(self.spark.range(1).select(F.lit(key).cast("long").alias("key"))).first()
        found = self.scan([one["bucket"]]).where(F.col("key") == key).select("value").first()
        return None if found is None else bytes(found[0])
