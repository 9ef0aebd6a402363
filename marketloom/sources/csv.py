"""Trade files as ticks: two layouts of one exchange's trades and one of another's, read as text columns and typed here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom import types
from marketloom.functions import flags
from marketloom.functions.fixedpoint import count_digits
from marketloom.functions.timeframe import seconds_to_ms

# Columns of the layouts, in order.
BINANCE = ["id", "price", "qty", "quote_qty", "time", "is_buyer_maker", "is_best_match"]
BYBIT = ["timestamp", "symbol", "side", "size", "price", "tickDirection"]
# A time under the first bound is in seconds, under the second in milliseconds, else in microseconds.
SECONDS_BELOW, MILLISECONDS_BELOW = 10_000_000_000, 10_000_000_000_000


#: What the first column of a header line says.
HEADERS = ["id", "trade_id", "tradeId", "timestamp"]


def _without_headers(rows: DataFrame, first: str, on_bad: str) -> DataFrame:
    """Header lines go; a row whose first column isn't a number otherwise is damaged, and raises, or goes where on_bad is drop."""
    rows = rows.where(~F.coalesce(F.trim(first).isin(*HEADERS), F.lit(False)))
    good = F.coalesce(F.col(first).rlike(r"^[0-9]+(\\.[0-9]+)?$"), F.lit(False))
    if on_bad == "drop":
        return rows.where(good)
    error = F.raise_error(F.concat(F.lit("a damaged row: "), F.coalesce(first, F.lit("")))).cast("string")
    return rows.withColumn(first, F.when(good, F.col(first)).otherwise(error))


def read_lines(spark: SparkSession, path: str, columns: list[str], on_bad: str = "raise") -> DataFrame:
    """The file's text columns, .gz included, without header lines. on_bad: raise or drop."""
    return _without_headers(spark.read.schema(", ".join(f"{c} string" for c in columns)).csv(path), columns[0], on_bad)


def split_lines(lines: DataFrame, columns: list[str], column: str = "value", on_bad: str = "raise") -> DataFrame:
    """The same from a column of whole lines, as archives give; empty lines go."""
    line = F.regexp_replace(column, "\r$", "")
    parts = F.split(line, ",")
    return _without_headers(lines.where(line != "").select(*(F.get(parts, k).alias(c) for k, c in enumerate(columns))), columns[0], on_bad)


def detect_digits(rows: DataFrame, price: str = "price", volume: str = "qty") -> DataFrame:
    """price_digits and volume_digits: the most decimal places in the texts."""
    most = lambda c: F.coalesce(F.max(count_digits(F.col(c))), F.lit(0))
    return rows.agg(most(price).alias("price_digits"), most(volume).alias("volume_digits"))


def _unit(first: Column) -> Column:
    return F.when(first < SECONDS_BELOW, F.lit(1000.0)).when(first < MILLISECONDS_BELOW, F.lit(1.0)).otherwise(F.lit(0.001))


def _ticks(rows: DataFrame, seq: Column, time: Column, mark: Column) -> DataFrame:
    number = lambda c: F.col(c).cast("double")
    volume = "qty" if "qty" in rows.columns else "size"
    return rows.select(
        seq.alias("seq"), time.alias("time_ms"), F.lit(0).cast("long").alias("received_ms"), F.lit(0.0).alias("ask"), F.lit(0.0).alias("bid"),
        number("price").alias("last"), number(volume).alias("volume"), mark.cast("long").alias("flags"),
    )


def binance_trades(rows: DataFrame, futures: bool = True, file: str | None = None, stretch: int = 1 << 20) -> DataFrame:
    """Ticks of the text rows. The time unit is that of the file's first trade (lowest id) for all of it; `file` names a column where many are read.

    A buyer who is maker marks FROM_BUY and else FROM_SELL; futures files take True and true, and mark BEST_MATCH; spot files take true
    alone. LAST_UPDATED marks a price that differs from that of the trade before by id; the first trade's always does.
    The first trade is found by one partial aggregate a file. A file's trades are dealt by stretches of `stretch` ids; the price before a stretch comes
    from a summary of one row a stretch, so no file is one task's work.
    """
    key = F.lit(0) if file is None else F.col(file)
    rows = rows.withColumn("file_key", key).withColumn("seq", F.col("id").cast("long")).withColumn("part", F.floor(F.col("seq") / stretch))
    units = rows.groupBy("file_key").agg(_unit(F.min_by(F.col("time").cast("double"), "seq")).alias("unit"))
    rows = rows.join(F.broadcast(units), "file_key") if file is None else rows.join(units, "file_key")
    ends = rows.groupBy("file_key", "part").agg(F.max_by(F.col("price").cast("double"), "seq").alias("end"))
    ends = ends.withColumn("carried", F.lag("end").over(Window.partitionBy("file_key").orderBy("part"))).drop("end")
    rows = rows.join(ends, ["file_key", "part"])
    before = F.lag(F.col("price").cast("double")).over(Window.partitionBy("file_key", "part").orderBy("seq"))
    before = F.coalesce(before, "carried", F.lit(-1.0))
    # The window's place is kept apart from the mark below, which reads it twice.
    rows = rows.withColumn("price_before", before)
    yes = ["true", "True"] if futures else ["true"]
    mark = F.when(F.col("is_buyer_maker").isin(*yes), types.FROM_BUY).otherwise(types.FROM_SELL)
    mark = mark + F.when(F.col("price").cast("double") != F.col("price_before"), types.LAST_UPDATED).otherwise(0)
    if futures:
        mark = mark + F.when(F.col("is_best_match").isin(*yes), types.BEST_MATCH).otherwise(0)
    time = F.when(F.col("unit") == 0.001, F.floor(F.col("time").cast("long") / 1000)).otherwise(F.col("time").cast("long") * F.col("unit"))
    return _ticks(rows, F.col("seq"), time.cast("long"), mark)


def bybit_trades(rows: DataFrame) -> DataFrame:
    """Ticks of the text rows; seq is the row's place in time. PlusTick and MinusTick mark LAST_UPDATED; Buy and Sell mark sides, other texts none."""
    side = F.when(F.col("side") == "Buy", types.FROM_BUY).when(F.col("side") == "Sell", types.FROM_SELL).otherwise(0)
    moved = F.when(F.col("tickDirection").isin("PlusTick", "MinusTick"), types.LAST_UPDATED).otherwise(0)
    return _ticks(rows, F.monotonically_increasing_id(), seconds_to_ms("timestamp"), side + moved)


def with_config(ticks: DataFrame, digits: DataFrame) -> types.TickCodecConfig:
    """The codec configuration of a file: trade ticks with flags and volume, at the digits found."""
    d = digits.first()
    on = types.TRADE_BASED | types.ENABLE_TICK_FLAGS | types.TICKS_ENABLE_VOLUME
    return types.TickCodecConfig(flags=on, price_digits=d.price_digits, volume_digits=d.volume_digits)


def flag_names(ticks: DataFrame) -> DataFrame:
    """ticks with one boolean a flag."""
    names = {"last_updated": types.LAST_UPDATED, "from_buy": types.FROM_BUY, "from_sell": types.FROM_SELL, "best_match": types.BEST_MATCH}
    return ticks.withColumns({k: flags.has(F.col("flags"), v) for k, v in names.items()})
