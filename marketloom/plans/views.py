"""The driver's tables in the shape of the market-data model, as DataFrames and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom import types
from marketloom.operators.bars import ticks_to_bars

HOUR, DAY = 3_600_000, 86_400_000
#: The month that the events lie in.
START, END = 1_704_067_200_000, 1_706_659_200_000
PERIODS = {"AUTOMOBILE": 3_600_000, "BUILDING": 14_400_000, "FURNITURE": 21_600_000, "HOUSEHOLD": 43_200_000, "MACHINERY": 86_400_000}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str):
    """Driver timestamps have no zone; they are UTC."""
    return F.unix_millis(F.col(column).cast("timestamp"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("symbol_id"), F.col("event_id").alias("seq"), millis("ts").alias("time_ms"), F.col("value").alias("last"),
        F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("volume"), F.round(F.col("value") * 100).cast("long").alias("px"),
    )
    before = F.coalesce(F.lag("last").over(Window.partitionBy("symbol_id").orderBy("time_ms", "seq")), F.lit(-1.0))
    mark = F.when(F.col("seq") % 2 == 0, types.FROM_BUY).otherwise(types.FROM_SELL) + F.when(F.col("last") != before, types.LAST_UPDATED).otherwise(0)
    return rows.select("*", (F.col("px") % 11).alias("spread"), mark.cast("long").alias("flags"))


def plain_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without LAST_UPDATED, and so without a window."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("symbol_id"), F.col("event_id").alias("seq"), millis("ts").alias("time_ms"), F.col("value").alias("last"),
        F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("volume"), F.round(F.col("value") * 100).cast("long").alias("px"),
    )
    side = F.when(F.col("seq") % 2 == 0, types.FROM_BUY).otherwise(types.FROM_SELL).cast("long")
    return rows.select("*", (F.col("px") % 11).alias("spread"), side.alias("flags"))


def bars(spark: SparkSession, sf_dir: str, interval_ms: int = HOUR) -> DataFrame:
    return ticks_to_bars(plain_ticks(spark, sf_dir), interval_ms)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows as trade files have them."""
    li = table(spark, sf_dir, "lineitem")
    price = F.format_string("%.2f", F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100)
    return li.groupBy("l_orderkey").agg(
        F.min("l_linenumber").alias("n"), F.min(price).alias("price"), F.sum(F.col("l_quantity").cast("long")).alias("qty"),
        F.min(millis("l_shipdate")).alias("time"), F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"),
    ).select(
        F.col("l_orderkey").cast("string").alias("id"), "price", F.col("qty").cast("string").alias("qty"), F.lit("0").alias("quote_qty"),
        F.col("time").cast("string").alias("time"), F.when(F.col("flag") == "A", "true").when(F.col("flag") == "N", "True").otherwise("false").alias("is_buyer_maker"),
        F.when(F.col("status") == "F", "true").otherwise("False").alias("is_best_match"),
    )


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rate = F.max(F.round((F.col("l_discount") - F.col("l_tax")) * 100).cast("long"))
    return li.groupBy(F.col("l_linenumber").alias("provider_id"), (F.col("l_partkey") % 50).alias("symbol_id"), millis("l_shipdate").alias("time_ms")).agg(
        (rate / 100).alias("funding_rate"), (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100).alias("mark_price"),
        F.max(F.when(F.col("l_returnflag") == "R", 0.01).otherwise(0.0)).alias("premium_index"), F.count("*").alias("size"),
    ).withColumn("period_ms", F.lit(HOUR * 8).cast("long"))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 8).cast("int").alias("market_type"), (F.col("p_partkey") % 33).cast("int").alias("exchange_id"),
        F.col("p_partkey").cast("int").alias("symbol_id"), (F.col("p_partkey") * 7919 + 20_000).alias("segment"), "p_size", "p_retailprice", "p_name",
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    period = F.lit(HOUR).cast("long")
    for name, ms in PERIODS.items():
        period = F.when(F.col("c_mktsegment") == name, F.lit(ms).cast("long")).otherwise(period)
    return table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") % 20).alias("listener"), (F.col("c_custkey") % 150).alias("symbol_id"), F.lit(0).alias("provider_id"), period.alias("period_ms")
    ).distinct()


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, pos, value): an array of small integers a user, with runs of zeros."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id", (F.floor("value").cast("long") % 5).alias("v"))
    pos = F.row_number().over(Window.partitionBy("k").orderBy("event_id")) - 1
    return rows.select("k", pos.cast("long").alias("pos"), F.when(F.col("v") > 2, F.lit(0).cast("long")).otherwise(F.col("v")).alias("value"))


SQL = {
    "plain_ticks": """plain_ticks AS (SELECT user_id AS symbol_id, event_id AS seq, (epoch_us(ts) // 1000) AS time_ms, value AS last, regexp_extract(props, '[0-9]+')::DOUBLE AS volume,
        round(value * 100)::BIGINT AS px, round(value * 100)::BIGINT % 11 AS spread, CASE WHEN event_id % 2 = 0 THEN 16 ELSE 32 END AS flags FROM events)""",
    "ticks": """ticks AS (SELECT * REPLACE (flags + CASE WHEN last <> coalesce(lag(last) OVER (PARTITION BY symbol_id ORDER BY time_ms, seq), -1) THEN 4 ELSE 0 END AS flags) FROM plain_ticks)""",
    "trades": """trades AS (SELECT l_orderkey AS id, min(printf('%.2f', round(l_extendedprice / l_quantity * 100) / 100)) AS price, sum(l_quantity::BIGINT) AS qty,
        min((epoch_us(l_shipdate) // 1000)) AS time, max(l_returnflag) AS flag, max(l_linestatus) AS status FROM lineitem GROUP BY 1)""",
    "funding": """funding AS (SELECT l_linenumber AS provider_id, l_partkey % 50 AS symbol_id, (epoch_us(l_shipdate) // 1000) AS time_ms,
        max(round((l_discount - l_tax) * 100)::BIGINT) / 100 AS funding_rate, sum(round(l_extendedprice * 100)::BIGINT) / 100 AS mark_price,
        max(CASE WHEN l_returnflag = 'R' THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END) AS premium_index, count(*) AS size, 28800000 AS period_ms FROM lineitem GROUP BY 1, 2, 3)""",
    "instruments": """instruments AS (SELECT (p_partkey % 8)::INT AS market_type, (p_partkey % 33)::INT AS exchange_id, p_partkey::INT AS symbol_id,
        p_partkey * 7919 + 20000 AS segment, p_size, p_retailprice, p_name FROM part)""",
    "subscriptions": "subscriptions AS (SELECT DISTINCT c_custkey % 20 AS listener, c_custkey % 150 AS symbol_id, 0 AS provider_id, CASE c_mktsegment "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PERIODS.items()) + " ELSE 3600000 END AS period_ms FROM customer)",
    "arrays": """arrays AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY event_id) - 1 AS pos, CASE WHEN v > 2 THEN 0 ELSE v END AS value
        FROM (SELECT user_id AS k, event_id, floor(value)::BIGINT % 5 AS v FROM events))""",
}


def bars_sql(name: str = "bars", interval_ms: int = HOUR) -> str:
    return f"""{name} AS (SELECT symbol_id, time_ms - time_ms % {interval_ms} AS time_ms, first(last ORDER BY time_ms, seq) AS open, max(last) AS high, min(last) AS low,
        last(last ORDER BY time_ms, seq) AS close, sum(volume) AS volume, sum(last * volume) AS quote_volume, sum(CASE WHEN flags & 16 <> 0 THEN volume ELSE 0 END) AS buy_volume,
        sum(CASE WHEN flags & 16 <> 0 THEN last * volume ELSE 0 END) AS buy_quote_volume, last(spread ORDER BY time_ms, seq) AS spread, count(*) AS tick_volume
        FROM plain_ticks GROUP BY symbol_id, time_ms - time_ms % {interval_ms})"""


def with_(*names: str) -> str:
    """WITH and the views named; views come before those that read them."""
    parts = []
    for n in names:
        if n == "ticks" or n == "bars":
            parts += [x for x in [SQL["plain_ticks"]] if x not in parts]
        parts.append(bars_sql() if n == "bars" else SQL[n])
    return "WITH " + ", ".join(parts) + " "
