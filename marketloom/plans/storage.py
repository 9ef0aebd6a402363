"""Queries that write to the shared folder and read back: stores, hubs, transactions, readers, archives, streams; with their SQL twins."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom import types
from marketloom.functions import fixedpoint
from marketloom.operators import bars, bitset, blobs, catalog, subscriptions
from marketloom.plans import views as v
from marketloom.plans.queries import query
from marketloom.plans.views import DAY, END, HOUR, START, with_
from marketloom.sources import archives, csv, datasource
from marketloom.sources.keyvalue import KeyValue
from marketloom.sources.shared import shared_folder
from marketloom.sources.store import Hub, Store, create, parameterised, sqlite_file, sqlite_rows
from marketloom.streaming import bars as streams

MIDDLE = START + 10 * DAY
KEY = ["cast(symbol_id AS int) AS symbol_id", "cast(symbol_id % 2 AS int) AS market_type", "cast(symbol_id % 3 AS int) AS exchange_id"]
KEY_SQL = "symbol_id, symbol_id % 2 AS market_type, symbol_id % 3 AS exchange_id"
BAR = "symbol_id, market_type, exchange_id, time_ms, open, close, volume, spread, tick_volume"
FUNDING_RATE = "funding_rate, mark_price, premium_index, period_ms"


def market_bars(spark, d) -> DataFrame:
    rows = v.bars(spark, d)
    return rows.selectExpr(*KEY, *(c.split()[0] for c in types.MARKET_BAR.split(", ")))


def market_ticks(spark, d) -> DataFrame:
    zero = [F.lit(0).cast("long").alias("received_ms"), F.lit(0.0).alias("ask"), F.lit(0.0).alias("bid")]
    return v.plain_ticks(spark, d).select(*map(F.expr, KEY), "seq", "time_ms", *zero, "last", "volume", "flags")


def market_funding(spark, d) -> DataFrame:
    rows = v.funding(spark, d).withColumn("market_type", F.lit(2)).withColumn("exchange_id", F.col("provider_id").cast("int"))
    return rows.select("market_type", "exchange_id", F.col("symbol_id").cast("int").alias("symbol_id"), "time_ms", "funding_rate", "mark_price", "premium_index", "period_ms")


def bar_store(spark, d, name: str = "bars") -> Store:
    """A store that has taken the bars in two writes, of which the second replaces some segments by the same rows."""
    s = create("PARQUET", spark, shared_folder(spark, name), name=name)
    rows = market_bars(spark, d)
    s.upsert("bars", rows, "H1")
    s.upsert("bars", rows.where(F.col("symbol_id") % 5 == 0), "H1")
    return s


def tick_store(spark, d) -> Store:
    s = Store(spark, shared_folder(spark, "ticks"), name="ticks")
    s.upsert("ticks", market_ticks(spark, d), "UNKNOWN")
    return s


def bar_sql(where: str = "true", columns: str = BAR) -> str:
    return with_("bars") + f", m AS (SELECT *, {KEY_SQL.replace('symbol_id, ', '', 1)} FROM bars) SELECT {columns} FROM m WHERE {where}"


def shown(rows: DataFrame) -> DataFrame:
    return rows.select(*(c.strip() for c in BAR.split(",")))


@query(bar_sql(f"time_ms >= {MIDDLE} AND time_ms < {MIDDLE + 3 * DAY + HOUR}"))
def store_bar_range(spark, d):
    return shown(bar_store(spark, d).read("bars", "H1", MIDDLE, MIDDLE + 3 * DAY + HOUR))


@query(bar_sql(f"time_ms // {DAY} = {MIDDLE // DAY} AND symbol_id = 7"))
def store_bar_segment(spark, d):
    return shown(bar_store(spark, d).read_segment("bars", "H1", MIDDLE // DAY, 1, 1, 7))


@query(bar_sql("true GROUP BY ALL", "symbol_id, market_type, exchange_id, 'H1' AS time_frame, min(time_ms) AS start_ms, max(time_ms) AS end_ms, count(*) AS n"))
def store_bar_metadata(spark, d):
    return bar_store(spark, d).metadata("bars")


@query(bar_sql("true", "'bars' AS store, 19 AS data_flags, min(time_ms) AS start_ms, max(time_ms) AS end_ms, array_to_string(list_sort(list(DISTINCT market_type)), ',') AS markets, array_to_string(list_sort(list(DISTINCT exchange_id)), ',') AS exchanges, array_to_string(list_sort(list(DISTINCT symbol_id)), ',') AS symbols"))
def store_bar_coverage(spark, d):
    text = [F.array_join(F.col(c).cast("array<string>"), ",").alias(n) for c, n in zip(catalog.SETS, ("markets", "exchanges", "symbols"), strict=True)]
    return bar_store(spark, d).coverage("bars").select("store", "data_flags", "start_ms", "end_ms", *text)


@query(with_("plain_ticks") + f"SELECT {KEY_SQL}, seq, time_ms, last, volume, flags FROM plain_ticks WHERE time_ms >= {MIDDLE} AND time_ms < {MIDDLE + 50 * HOUR}")
def store_tick_range(spark, d):
    return tick_store(spark, d).read("ticks", "UNKNOWN", MIDDLE, MIDDLE + 50 * HOUR).select("symbol_id", "market_type", "exchange_id", "seq", "time_ms", "last", "volume", "flags")


@query(with_("plain_ticks") + f"SELECT {KEY_SQL}, time_ms // {HOUR} AS segment, min(time_ms) AS start_ms, max(time_ms) AS end_ms, count(*) AS n FROM plain_ticks GROUP BY ALL")
def store_tick_metadata(spark, d):
    return tick_store(spark, d).segments("ticks").select("symbol_id", "market_type", "exchange_id", "segment", "start_ms", "end_ms", F.col("count").alias("n"))


@query(with_("funding") + f"SELECT provider_id AS exchange_id, symbol_id, time_ms, CASE WHEN symbol_id % 4 = 0 THEN funding_rate + 1 ELSE funding_rate END AS funding_rate, mark_price, premium_index, period_ms FROM funding WHERE time_ms >= 800000000000 AND time_ms < 850000000000")
def store_funding_range(spark, d):
    s = Store(spark, shared_folder(spark, "funding"))
    rows = market_funding(spark, d)
    s.upsert("funding", rows, "UNKNOWN")
    s.upsert("funding", rows.where("symbol_id % 4 = 0").withColumn("funding_rate", F.col("funding_rate") + 1), "UNKNOWN")
    return s.read("funding", "UNKNOWN", 800_000_000_000, 850_000_000_000).select("exchange_id", "symbol_id", "time_ms", *FUNDING_RATE.split(", "))


@query(with_("funding") + "SELECT provider_id AS exchange_id, symbol_id, min(time_ms) AS start_ms, max(time_ms) AS end_ms, count(*) AS n FROM funding GROUP BY ALL")
def store_funding_metadata(spark, d):
    s = Store(spark, shared_folder(spark, "funding"))
    s.upsert("funding", market_funding(spark, d), "UNKNOWN")
    return s.metadata("funding").select("exchange_id", "symbol_id", "start_ms", "end_ms", "n")


def _values(spark, d, bits: int) -> KeyValue:
    kv = KeyValue(spark, shared_folder(spark, f"kv{bits}"), bits)
    rows = v.table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.encode("p_name", "UTF-8").alias("value"))
    kv.put(rows)
    kv.put(rows.where("key % 3 = 0").withColumn("value", F.encode(F.lit("new"), "UTF-8")))
    return kv


_VALUE = "CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_name END AS value"


@query(f"SELECT p_partkey AS key, {_VALUE} FROM part")
def kv_full_scan(spark, d):
    return _values(spark, d, 32).scan().select("key", F.decode("value", "UTF-8").alias("value"))


@query(f"SELECT p_partkey AS key, {_VALUE} FROM part WHERE p_partkey % 7 = 0")
def kv_point_gets(spark, d):
    keys = v.table(spark, d, "part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("key"))
    return _values(spark, d, 64).get(keys.unionByName(keys.withColumn("key", -F.col("key")))).select("key", F.decode("value", "UTF-8").alias("value"))


@query(bar_sql("NOT (market_type = 1 AND exchange_id = 1 AND symbol_id = 7)"))
def store_erase_series(spark, d):
    s = bar_store(spark, d)
    s.erase("bars", market=1, exchange=1, symbol=7)
    return shown(s.scan("bars"))


@query(bar_sql(f"NOT (market_type = 0 AND time_ms // {DAY} BETWEEN {MIDDLE // DAY} AND {MIDDLE // DAY + 2})"))
def store_erase_range(spark, d):
    s = bar_store(spark, d)
    s.erase("bars", frame="H1", market=0, start_ms=MIDDLE + HOUR, end_ms=MIDDLE + 2 * DAY + HOUR)
    return shown(s.scan("bars"))


@query(bar_sql(f"NOT (market_type IN (0, 1) AND exchange_id IN (0, 2) AND symbol_id < 40 AND time_ms // {DAY} >= {MIDDLE // DAY})"))
def store_erase_by_metadata(spark, d):
    s = bar_store(spark, d)
    s.erase_by_metadata("bars", {"market_types": [0, 1], "exchange_ids": [0, 2], "symbol_ids": list(range(40)), "start_ms": MIDDLE, "end_ms": 0})
    return shown(s.scan("bars"))


@query(bar_sql("false"))
def store_erase_all(spark, d):
    s = bar_store(spark, d)
    s.erase("bars")
    return shown(s.scan("bars"))


def _hub(spark, d) -> Hub:
    """Store a has the even symbols, store b all of them with another spread."""
    hub, root, rows = Hub(spark), shared_folder(spark, "hub"), market_bars(spark, d)
    for n in "ab":
        hub.add(create("PARQUET", spark, f"{root}/{n}", name=n))
    hub.start()
    with hub.transaction() as t:
        t.add(hub.upsert, "bars", rows.where("symbol_id % 2 = 0"), "H1", "a")
        t.add(hub.upsert, "bars", rows.withColumn("spread", F.col("spread") + 100), "H1", "b")
        t.commit()
    return hub


@query(bar_sql(columns=BAR.replace("spread", "CASE WHEN symbol_id % 2 = 0 THEN spread ELSE spread + 100 END AS spread")))
def hub_first_store_wins(spark, d):
    return shown(_hub(spark, d).read("bars", "H1", START - DAY, END + DAY))


@query(bar_sql("symbol_id % 2 = 0"))
def hub_failed_transaction_is_undone(spark, d):
    hub = _hub(spark, d)

    def fails() -> None:
        raise RuntimeError("a step fails")

    try:
        with hub.transaction() as t:
            t.add(hub.upsert, "bars", market_bars(spark, d).withColumn("spread", F.lit(-1).cast("long")), "H1", "a")
            t.add(hub.erase, "bars")
            t.add(fails)
            t.commit()
    except RuntimeError:
        pass
    with hub.transaction() as t:
        t.add(hub.erase, "bars")  # never committed
    return shown(hub.stores[0].scan("bars"))


@query(bar_sql("true GROUP BY 1, 2", "'a' AS store, 0 AS priority, count(DISTINCT symbol_id) AS symbols").replace("WHERE true GROUP BY 1, 2", "WHERE symbol_id % 2 = 0")
       + " UNION ALL SELECT 'b', 1, count(DISTINCT symbol_id) FROM m")
def hub_metadata(spark, d):
    return _hub(spark, d).metadata("bars").select("store", "priority", F.size("symbol_ids").cast("long").alias("symbols"))


@query(with_("funding") + "SELECT provider_id, symbol_id, time_ms, funding_rate FROM funding WHERE symbol_id = 8 AND time_ms >= 800000000000 AND time_ms < 850000000000")
def sqlite_file_rows(spark, d):
    rows = v.funding(spark, d).select("provider_id", "symbol_id", "time_ms", "funding_rate", (F.col("provider_id") % 2).alias("file"))
    place = shared_folder(spark, "sqlite")
    sqlite_file(rows, "funding", "file").write.parquet(place)
    sql = "SELECT provider_id, symbol_id, time_ms, funding_rate FROM funding WHERE symbol_id = 8 AND time_ms >= 800000000000 AND time_ms < 850000000000"
    return sqlite_rows(spark.read.parquet(place), sql, "provider_id long, symbol_id long, time_ms long, funding_rate double")


@query(with_("funding") + "SELECT provider_id, count(*) AS n FROM funding WHERE symbol_id = 3 AND funding_rate < 0.02 GROUP BY 1")
def sql_bound_parameters(spark, d):
    sql = "SELECT provider_id, count(*) AS n FROM {f} WHERE symbol_id = :symbol AND funding_rate < :most GROUP BY provider_id"
    return parameterised(spark, sql, {"f": v.funding(spark, d)}, symbol=3, most=0.02)


_SIDE = "CASE WHEN flag = 'A' OR flag = 'N' THEN 16 ELSE 32 END + CASE WHEN price::DOUBLE <> coalesce(lag(price::DOUBLE) OVER (PARTITION BY id % 4 ORDER BY id), -1) THEN 4 ELSE 0 END + CASE WHEN status = 'F' THEN 64 ELSE 0 END"
_TRADE = with_("trades") + f"SELECT id AS seq, time AS time_ms, price::DOUBLE AS last, qty::DOUBLE AS volume, ({_SIDE})::BIGINT AS flags FROM trades"


@query(_TRADE)
def csv_gzip_files(spark, d):
    """Gzip files of trades with a header line, one a fourth of the ids, by the file reader."""
    rows, place = v.trades(spark, d), shared_folder(spark, "gzip")
    rows.withColumn("file", F.col("id").cast("long") % 4).repartition(4, "file").write.partitionBy("file").option("compression", "gzip").option("header", True).csv(place)
    read = csv.read_lines(spark, place, csv.BINANCE)
    return csv.binance_trades(read, futures=True, file="file", stretch=1000).select("seq", "time_ms", "last", "volume", "flags")


def _zipped(rows: DataFrame) -> DataFrame:
    """path, content: a zip archive a file, of a text member with a header and a folder."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("folder/", "")
            z.writestr(f"folder/trades-{key[0]}.csv", "id,price,qty,quote_qty,time,is_buyer_maker,is_best_match\n" + pdf[csv.BINANCE].to_csv(header=False, index=False))
        return pd.DataFrame({"path": [f"{key[0]}.zip"], "content": [made.getvalue()]})

    return rows.groupBy("file").applyInPandas(run, "path string, content binary")


@query(_TRADE)
def csv_zip_files(spark, d):
    place = shared_folder(spark, "zip")
    _zipped(v.trades(spark, d).withColumn("file", (F.col("id").cast("long") % 4).cast("string"))).write.parquet(place)
    lines = archives.unzip_lines(spark.read.parquet(place))
    rows = csv.split_lines(lines, csv.BINANCE).withColumn("file", F.col("id").cast("long") % 4)
    return csv.binance_trades(rows, futures=True, file="file", stretch=1000).select("seq", "time_ms", "last", "volume", "flags")


@query("SELECT count(*) AS n, sum(length(p_name) + 1) AS bytes FROM part")
def gunzip_members(spark, d):
    """Whole gzip members held as rows."""
    import gzip

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [str(key[0])], "content": [gzip.compress("".join(f"{x}\n" for x in pdf["p_name"]).encode())]})

    place = shared_folder(spark, "members")
    v.table(spark, d, "part").select((F.col("p_partkey") % 5).alias("k"), "p_name").groupBy("k").applyInPandas(pack, "path string, content binary").write.parquet(place)
    out = archives.gunzip(spark.read.parquet(place)).select(F.decode("content", "UTF-8").alias("text"))
    return out.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("n"), F.sum(F.length("text")).alias("bytes"))


@query(with_("plain_ticks") + f"SELECT symbol_id, seq, time_ms, last, (SELECT count(DISTINCT symbol_id) FROM plain_ticks) AS symbols, (SELECT count(DISTINCT symbol_id % 3) FROM plain_ticks) AS providers FROM plain_ticks WHERE symbol_id = 7 AND time_ms >= {MIDDLE} AND time_ms < {MIDDLE + 5 * DAY}")
def data_source_ticks(spark, d):
    source = datasource.StoreSource(tick_store(spark, d), {(7, 1): types.RestoreConfig("FIXED_SPREAD", 3, 2)})
    assert source.restore_config(7, 1).fixed_spread == 3 and source.restore_config(8, 1).mode == "NONE"
    rows = source.fetch_ticks(7, 1, MIDDLE, MIDDLE + 5 * DAY)
    return rows.select("symbol_id", "seq", "time_ms", "last", F.lit(source.symbol_count()).cast("long").alias("symbols"), F.lit(source.provider_count()).cast("long").alias("providers"))


@query("SELECT p_partkey AS k, p_size + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS size, p_partkey % 4 = 0 AS written FROM part")
def metadata_put_changed(spark, d):
    held = v.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))
    new = held.where("k % 2 = 0").withColumn("size", F.when(F.col("k") % 4 == 0, F.col("size") + 1).otherwise(F.col("size")).cast(held.schema["size"].dataType))
    after, changed = catalog.put_changed(held, new, ["k"])
    return after.join(changed.select("k", F.lit(True).alias("written")), "k", "left").withColumn("written", F.coalesce("written", F.lit(False)))


@query(with_("bars") + "SELECT symbol_id, time_ms, open, high, low, close, volume FROM bars")
def bars_projected(spark, d):
    return bars.project(v.bars(spark, d), types.OHLCV_BAR, ["symbol_id"])


@query("SELECT pos FROM (SELECT DISTINCT event_id % 97 AS pos FROM events WHERE event_id % 97 <> 5 UNION SELECT 101) WHERE pos < 102")
def bitset_set_reset(spark, d):
    a = v.table(spark, d, "events").select((F.col("event_id") % 97).alias("pos")).distinct()
    return bitset.resize(bitset.reset(bitset.put(a, 101, 128), 5, 128), 102).select("pos")


@query(with_("plain_ticks") + "SELECT symbol_id, seq, round(last * 100)::BIGINT AS fixed, round(last * 100)::BIGINT / 100 AS back, round(last * 100)::BIGINT::DOUBLE AS as_double FROM plain_ticks")
def double_to_int64(spark, d):
    fixed = fixedpoint.to_fixed(F.col("last"), 2).cast("long")
    rows = v.plain_ticks(spark, d).select("symbol_id", "seq", fixed.alias("fixed"))
    return rows.select("*", fixedpoint.from_fixed(F.col("fixed"), 2).alias("back"), F.col("fixed").cast("double").alias("as_double"))


@query("SELECT p_partkey AS k, md5(repeat(p_name, 20)) AS plain, true AS smaller FROM part")
def zstd_round_trip(spark, d):
    """Each text, packed and unpacked with a dictionary trained on a bounded sample of them."""
    rows = v.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.encode(F.repeat("p_name", 20), "UTF-8").alias("blob"))
    words = blobs.train_dictionary(rows.select("blob"), 4096)

    def run(batches):
        for pdf in batches:
            packed = [blobs.compress(bytes(x), 3, words) for x in pdf["blob"]]
            yield pd.DataFrame({"k": pdf["k"], "back": [blobs.decompress(x, words) for x in packed], "smaller": [len(x) < len(y) for x, y in zip(packed, pdf["blob"], strict=True)]})

    return rows.mapInPandas(run, "k long, back binary, smaller boolean").select("k", F.md5("back").alias("plain"), "smaller")


@query(with_("subscriptions") + f"SELECT DISTINCT listener, 'TEST_START' AS event, {START} AS time_ms FROM subscriptions WHERE symbol_id % 3 <> 0")
def subscriptions_start(spark, d):
    subs = v.subscriptions(spark, d)
    left = subscriptions.unsubscribe(subs, subs.where("symbol_id % 3 = 0"))
    return subscriptions.start(left, START)


@query(with_("plain_ticks", "subscriptions") + f""", due AS (SELECT DISTINCT listener, symbol_id FROM subscriptions WHERE period_ms <= 21600000)
    SELECT listener, count(*) AS ticks FROM plain_ticks JOIN due USING (symbol_id) WHERE time_ms >= {MIDDLE} AND time_ms < {MIDDLE + 7 * HOUR} GROUP BY 1""")
def bus_step(spark, d):
    """A step of seven hours: listeners of periods up to six are due, those of twelve hours and a day aren't."""
    next_ms = {p: MIDDLE + p for p in v.PERIODS.values()}
    return subscriptions.update(v.subscriptions(spark, d), v.plain_ticks(spark, d), MIDDLE, MIDDLE + 7 * HOUR, next_ms)[0]


# Streams: the ticks are written as files in order of time, and every query reads them in several micro-batches.

TICK = "symbol_id long, seq long, time_ms long, last double, volume double, px long, spread long, flags long"


def _stream(spark, d, name: str, rows: DataFrame | None = None) -> tuple[DataFrame, str]:
    place = shared_folder(spark, name)
    rows = v.ticks(spark, d) if rows is None else rows
    cuts = [START + k * 8 * DAY for k in range(4)]
    for a, z in zip([0, *cuts[1:]], [*cuts[1:], 1 << 60]):
        rows.where((F.col("time_ms") >= a) & (F.col("time_ms") < z)).coalesce(1).sortWithinPartitions("time_ms", "seq").write.mode("append").parquet(f"{place}/in")
    return streams.tick_stream(spark, f"{place}/in", TICK), place


def _sunk(out: DataFrame, place: str) -> DataFrame:
    q = out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{place}/out")


@query(with_("plain_ticks") + f""", b AS (SELECT symbol_id, time_ms - time_ms % {DAY} AS time_ms, first(last ORDER BY time_ms, seq) AS open, max(last) AS high, min(last) AS low,
    last(last ORDER BY time_ms, seq) AS close, sum(volume) AS volume, count(*) AS tick_volume FROM plain_ticks GROUP BY 1, 2)
    SELECT * FROM b WHERE time_ms + {DAY} <= (SELECT max(time_ms) FROM plain_ticks)""")
def stream_daily_bars(spark, d):
    """Bars whose day is over; the open day has not come yet."""
    source, place = _stream(spark, d, "stream-bars", v.plain_ticks(spark, d))
    return _sunk(streams.stream_bars(source, DAY), place)


def _restored_twin(name: str) -> str:
    from marketloom.plans.queries import ORACLES

    return f"SELECT symbol_id, seq, flags, round(bid, 4) AS bid, round(ask, 4) AS ask FROM ({ORACLES[name]})"


@query(_restored_twin("restore_median"))
def stream_restored_median(spark, d):
    source, place = _stream(spark, d, "stream-restore")
    out = _sunk(streams.stream_restore(source, types.RestoreConfig("MEDIAN_SPREAD", 5, 2)), place)
    return out.select("symbol_id", "seq", "flags", F.round("bid", 4).alias("bid"), F.round("ask", 4).alias("ask"))


@query(with_("plain_ticks") + f""", o AS (SELECT *, lag(time_ms) OVER w AS tb, lag(last) OVER w AS lb FROM plain_ticks WINDOW w AS (PARTITION BY symbol_id ORDER BY time_ms, seq))
    SELECT time_ms // {HOUR} AS hour, symbol_id, seq, flags + CASE WHEN lb <> last THEN 4 ELSE 0 END AS flags FROM o WHERE tb IS NULL OR time_ms > tb""")
def stream_appended_hours(spark, d):
    """Ticks in strict order of time, marked by price changes, in folders by hour."""
    source, place = _stream(spark, d, "stream-hours", v.plain_ticks(spark, d))
    streams.append_hours(streams.ordered(source), f"{place}/out", f"{place}/check").start().awaitTermination()
    return spark.read.schema(f"{TICK}, hour long").parquet(f"{place}/out").select("hour", "symbol_id", "seq", "flags")


@query(with_("plain_ticks", "subscriptions") + "SELECT listener, count(*) AS ticks FROM plain_ticks JOIN (SELECT DISTINCT listener, symbol_id FROM subscriptions) USING (symbol_id) GROUP BY 1")
def stream_notified(spark, d):
    """What listeners were told over several steps; each step is past all their periods."""
    source, place = _stream(spark, d, "stream-notify", v.plain_ticks(spark, d))

    def told(rows: DataFrame, number: int) -> None:
        rows.groupBy("listener").agg(F.count("*").alias("ticks")).write.mode("overwrite").parquet(f"{place}/told/batch={number}")

    streams.notify(source, v.subscriptions(spark, d), told, f"{place}/check").start().awaitTermination()
    return spark.read.parquet(f"{place}/told").groupBy("listener").agg(F.sum("ticks").alias("ticks"))
