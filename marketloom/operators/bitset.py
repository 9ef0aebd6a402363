"""Bit sets as relations: a row (name, pos) a set bit, with the set's size beside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _checked(pos: Column, size: Column) -> Column:
    return F.when((pos >= 0) & (pos < size), pos).otherwise(F.raise_error(F.lit("a bit is out of range")).cast(LONG))


LONG = "long"


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("pos").intersect(b.select("pos"))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("pos").union(b.select("pos")).distinct()


def shift_left(a: DataFrame, n: int, size: int) -> DataFrame:
    """Towards higher places; bits beyond the size are lost."""
    return a.select((F.col("pos") + n).cast(LONG).alias("pos")).where(F.col("pos") < size)


def shift_right(a: DataFrame, n: int) -> DataFrame:
    return a.select((F.col("pos") - n).cast(LONG).alias("pos")).where(F.col("pos") >= 0)


def put(a: DataFrame, pos: int, size: int) -> DataFrame:
    if not 0 <= pos < size:
        raise IndexError("a bit is out of range")
    return a.select("pos").union(a.sparkSession.range(pos, pos + 1).toDF("pos")).distinct()


def reset(a: DataFrame, pos: int, size: int) -> DataFrame:
    if not 0 <= pos < size:
        raise IndexError("a bit is out of range")
    return a.where(F.col("pos") != pos)


def is_set(a: DataFrame, pos: int, size: int) -> bool:
    if not 0 <= pos < size:
        raise IndexError("a bit is out of range")
    return not a.where(F.col("pos") == pos).isEmpty()


def resize(a: DataFrame, size: int) -> DataFrame:
    return a.where(F.col("pos") < size)


def clear(a: DataFrame) -> DataFrame:
    return a.where(F.lit(False))


def checked(a: DataFrame, size: int) -> DataFrame:
    """The set; an error if a bit lies outside it."""
    return a.withColumn("pos", _checked(F.col("pos"), F.lit(size)))
