"""JSON forms of ticks, bars and records. Written, zero members of ticks and bars are left out; read, absent ones are zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.keys import pack_trade_id, unpack_trade_id

#: Members that stay when zero.
KEPT = {"time_ms"}


def to_json(row: DataFrame | None, columns: list[str], kept: set[str] = KEPT) -> Column:
    return F.to_json(F.struct(*(F.col(c) if c in kept else F.nullif(F.col(c), F.lit(0)).alias(c) for c in columns)))


def from_json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


def read_json(rows: DataFrame, text: str, schema: str) -> DataFrame:
    """rows with the JSON's members as columns, numbers that it leaves out as zero."""
    from pyspark.sql.types import NumericType, StructType

    parsed = rows.withColumn("parsed", from_json(F.col(text), schema))
    members = StructType.fromDDL(schema).fields
    columns = [F.coalesce(F.col(f"parsed.{m.name}"), F.lit(0).cast(m.dataType)).alias(m.name) if isinstance(m.dataType, NumericType) else F.col(f"parsed.{m.name}").alias(m.name) for m in members]
    return parsed.select(*(c for c in rows.columns if c != text), *columns)


def read_trade_json(rows: DataFrame, text: str) -> DataFrame:
    """Trade ticks, whose id and side are packed in one member or stand apart."""
    schema = "price double, volume double, time_ms long, id_and_side long, trade_id long, side int"
    out = read_json(rows.withColumn("had", F.get_json_object(text, "$.id_and_side").isNotNull()), text, schema)
    packed = F.when(F.col("had"), F.col("id_and_side")).otherwise(pack_trade_id(F.col("trade_id"), F.col("side")))
    out = out.withColumn("id_and_side", packed).drop("had", "trade_id", "side")
    return out.withColumns(unpack_trade_id(F.col("id_and_side")))


def rows_to_json(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One JSON array a key, in order; a key's rows are one segment."""
    return rows.groupBy(*keys).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(order, *(c for c in columns if c != order)))), lambda x: x)).alias("json"))


def map_from_json(text: Column, schema: str) -> Column:
    """A JSON object of named records."""
    return F.from_json(text, f"map<string, struct<{schema}>>")
