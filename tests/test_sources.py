import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from marketloom import types
from marketloom.sources import archives, csv, datasource, records, store

DAY = 86_400_000
T0 = 20_180 * DAY


def test_binance_files(spark, tmp_path):
    lines = ["id,price,qty,quote_qty,time,is_buyer_maker,is_best_match", "1,10.50,1,0,1700000000,true,true", "2,10.50,2.125,0,1700000001,False,True", "3,10.4,3,0,1700000002,True,false"]
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    rows = csv.read_lines(spark, str(tmp_path / "x.csv.gz"), csv.BINANCE)
    got = csv.binance_trades(rows).orderBy("seq").collect()
    assert [(r.time_ms, r.last, r.volume, r.flags) for r in got] == [
        (1700000000000, 10.5, 1.0, 16 | 4 | 64), (1700000001000, 10.5, 2.125, 32 | 64), (1700000002000, 10.4, 3.0, 16 | 4),
    ]
    spot = csv.binance_trades(rows, futures=False).orderBy("seq").collect()
    assert [r.flags for r in spot] == [16 | 4, 32, 32 | 4]
    config = csv.with_config(rows, csv.detect_digits(rows))
    assert (config.price_digits, config.volume_digits) == (2, 3) and config.has(types.TRADE_BASED)


@pytest.mark.parametrize("first,want", [("1700000000", 1700000000000), ("1700000000123", 1700000000123), ("1700000000123456", 1700000000123)])
def test_time_unit_of_the_first_row(spark, first, want):
    rows = spark.createDataFrame([("1", "1", "1", "1", first, "true", "true")], ", ".join(f"{c} string" for c in csv.BINANCE))
    assert csv.binance_trades(rows).first().time_ms == want


def test_bybit_files(spark):
    data = [("1700000000.1234", "X", "Buy", "1", "5.5", "PlusTick"), ("1700000001.5", "X", "Sell", "2", "5.5", "ZeroMinusTick"), ("1700000002", "X", "?", "2", "5", "MinusTick")]
    rows = spark.createDataFrame(data, ", ".join(f"{c} string" for c in csv.BYBIT))
    got = csv.bybit_trades(rows).orderBy("time_ms").collect()
    assert [(r.time_ms, r.flags) for r in got] == [(1700000000123, 16 | 4), (1700000001500, 32), (1700000002000, 4)]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("folder/", "")
        z.writestr("folder/x.csv", "1,2\r\n3,4\n")
        z.writestr("y.csv", "5,6\n")
    files = archives.binary_files(spark, str(tmp_path / "a.zip"))
    assert [r.name for r in archives.unzip(files).collect()] == ["folder/x.csv", "y.csv"]
    assert [r.name for r in archives.unzip(files, first_only=True).collect()] == ["folder/x.csv"]
    lines = csv.split_lines(archives.unzip_lines(files), ["a", "b"])
    assert sorted(tuple(r) for r in lines.collect()) == [("1", "2"), ("3", "4"), ("5", "6")]
    packed = spark.createDataFrame([("p", bytearray(gzip.compress(b"hello")))], "path string, content binary")
    assert bytes(archives.gunzip(packed).first().content) == b"hello"
    for data, most, said in ((b"", 10, "empty"), (b"hello", 3, "too large")):
        with pytest.raises(Exception, match=said):
            archives.gunzip(spark.createDataFrame([("p", bytearray(gzip.compress(data)))], "path string, content binary"), most).collect()
    assert io is not None


def test_json_records(spark):
    rows = spark.createDataFrame([(1, 5, 0.0, 2.5), (2, 0, 1.0, 0.0)], "id int, time_ms long, last double, volume double")
    text = rows.select("id", records.to_json(rows, ["time_ms", "last", "volume"]).alias("json"))
    assert [r.json for r in text.orderBy("id").collect()] == ['{"time_ms":5,"volume":2.5}', '{"time_ms":0,"last":1.0}']
    assert sorted(tuple(r) for r in records.read_json(text, "json", "time_ms long, last double, volume double").collect()) == sorted(tuple(r) for r in rows.collect())
    both = spark.createDataFrame([('{"price":1,"id_and_side":42}',), ('{"price":1,"trade_id":5,"side":2}',)], "json string")
    assert [(r.trade_id, r.side, r.id_and_side) for r in records.read_trade_json(both, "json").collect()] == [(5, 2, 42), (5, 2, 42)]
    arrays = records.rows_to_json(rows.withColumn("k", F.lit(1)), ["k"], "time_ms", ["last"]).first().json
    assert arrays == '[{"time_ms":0,"last":1.0},{"time_ms":5,"last":0.0}]'
    named = spark.createDataFrame([('{"a":{"time_ms":3}}',)], "json string").select(records.map_from_json(F.col("json"), "time_ms long").alias("m")).first().m
    assert named["a"].time_ms == 3


def day(spark, market, exchange, symbol, n=1440, start=T0, shift=0.0):
    i = F.col("id")
    return spark.range(n).select(
        F.lit(market).alias("market_type"), F.lit(exchange).alias("exchange_id"), F.lit(symbol).alias("symbol_id"), (F.lit(start) + i * 60_000).alias("time_ms"),
        (1 + i + shift).alias("open"), (1.1 + i).alias("high"), (0.9 + i).alias("low"), (1.05 + i).alias("close"), (100.0 + i).alias("volume"), (200.0 + i).alias("quote_volume"),
        (50.0 + i).alias("buy_volume"), (80.0 + i).alias("buy_quote_volume"), i.alias("spread"), i.alias("tick_volume"),
    )


def test_store_end_to_end(spark, tmp_path):
    s = store.create("PARQUET", spark, f"file://{tmp_path}/a", name="a")
    assert s.scan("bars").count() == 0
    series = [(1, 1, 100, 0), (1, 1, 101, 1), (2, 1, 102, 0)]
    for m, e, sym, k in series:
        s.upsert("bars", day(spark, m, e, sym, start=T0 + k * DAY), "M1")
    for m, e, sym, k in series:
        got = s.read("bars", "M1", T0, T0 + 30 * DAY, market=m, exchange=e, symbol=sym)
        want = day(spark, m, e, sym, start=T0 + k * DAY)
        assert got.count() == 1440 and got.select(*want.columns).exceptAll(want).isEmpty()
    plan = s.read("bars", "M1", T0, T0 + DAY)._jdf.queryExecution().executedPlan().toString()
    assert "segment" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "time_ms" in plan.split("PushedFilters")[1]
    # A write replaces its own series and segment only.
    s.upsert("bars", day(spark, 1, 1, 100, n=5, shift=9.0), "M1")
    assert {(r.symbol_id, r.n) for r in s.metadata().collect()} == {(100, 5), (101, 1440), (102, 1440)}
    assert s.read_segment("bars", "M1", T0 // DAY, 1, 1, 100).agg(F.min("open")).first()[0] == 10.0
    s.erase("bars", frame="M1", market=1, start_ms=T0 + DAY + 5, end_ms=T0 + DAY + 6)
    assert {r.symbol_id for r in s.metadata().collect()} == {100, 102}
    s.erase_by_metadata("bars", {"market_types": [2], "exchange_ids": [1], "symbol_ids": [102], "start_ms": 0, "end_ms": 0})
    assert {r.symbol_id for r in s.metadata().collect()} == {100}
    with pytest.raises(ValueError):
        s.erase("bars", start_ms=0)
    with pytest.raises(ValueError):
        store.create("OTHER", spark, str(tmp_path))


def test_hub_routes_and_commits(spark, tmp_path):
    a, b = (store.Store(spark, f"file://{tmp_path}/{n}", name=n) for n in "ab")
    hub = store.Hub(spark)
    with pytest.raises(RuntimeError):
        hub.start()
    hub.add(a)
    hub.add(b)
    hub.start()
    with pytest.raises(RuntimeError):
        hub.add(a)
    with hub.transaction() as t:
        t.add(hub.upsert, "bars", day(spark, 1, 1, 1, n=3), "M1", "a")
        t.add(hub.upsert, "bars", day(spark, 1, 1, 1, n=7, shift=5.0), "M1", "b")
        t.add(hub.upsert, "bars", day(spark, 1, 1, 2, n=7), "M1", "b")
        t.commit()
    with hub.transaction() as t:
        t.add(hub.erase, "bars")
    got = hub.read("bars", "M1", T0, T0 + DAY).groupBy("symbol_id").count().collect()
    assert {(r.symbol_id, r["count"]) for r in got} == {(1, 3), (2, 7)}
    assert {r.store: r.symbol_ids for r in hub.metadata().collect()} == {"a": [1], "b": [1, 2]}
    hub.erase("bars")
    assert hub.read("bars", "M1", T0, T0 + DAY).count() == 0
    hub.stop()
    assert not hub.is_connected()


def test_ticks_in_hours(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/t")
    rows = spark.range(100).select(
        F.lit(1).alias("market_type"), (F.col("id") % 2).cast("int").alias("exchange_id"), F.lit(3).alias("symbol_id"), F.col("id").alias("seq"), (T0 + F.col("id") * 100_000).alias("time_ms"),
        F.lit(0).cast("long").alias("received_ms"), F.lit(0.0).alias("ask"), F.lit(0.0).alias("bid"), F.col("id").cast("double").alias("last"), F.lit(1.0).alias("volume"), F.lit(16).cast("long").alias("flags"),
    )
    s.upsert("ticks", rows, "UNKNOWN")
    source = datasource.StoreSource(s, {(3, 1): types.RestoreConfig("FIXED_SPREAD", 2, 2)})
    assert (source.symbol_count(), source.provider_count(), source.restore_config(3, 1).fixed_spread, source.restore_config(0, 0).mode) == (1, 2, 2, "NONE")
    assert source.fetch_ticks(3, 1, T0, T0 + 3_600_000).count() == 18
    assert source.fetch_index(13, 10, T0, T0 + 3_600_000).count() == 18
    got = store.parameterised(spark, "SELECT count(*) AS n FROM {t} WHERE last BETWEEN :a AND :b", {"t": s.scan("ticks")}, a=10, b=12)
    assert got.first().n == 3
