import pytest
from pyspark.sql import functions as F

from marketloom import types
from marketloom.operators import spread
from marketloom.streaming import bars as streams

SCHEMA = "symbol_id long, seq long, time_ms long, last double, volume double, flags long"


def ticks(spark, n=400):
    i = F.col("id")
    last = F.round(100 + (i * 7919 % 13) / 100, 2)
    return spark.range(n).select((i % 3).alias("symbol_id"), i.alias("seq"), (i * 37_000).alias("time_ms"), last.alias("last"), F.lit(1.0).alias("volume"), (F.when(i * 31 % 7 < 3, 16).otherwise(32) + 4).cast("long").alias("flags"))


@pytest.fixture
def folder(spark, tmp_path):
    ticks(spark).orderBy("seq").coalesce(1).write.parquet(str(tmp_path / "in"))
    return tmp_path


def run(query, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_bars_are_the_batch_bars(spark, folder):
    run(streams.stream_bars(streams.tick_stream(spark, str(folder / "in"), SCHEMA), 3_600_000), "stream_bars")
    got = {(r.symbol_id, r.time_ms): (r.open, r.close, r.tick_volume) for r in spark.table("stream_bars").collect()}
    order = F.struct("time_ms", "seq")
    want = ticks(spark).groupBy("symbol_id", (F.col("time_ms") - F.col("time_ms") % 3_600_000).alias("t")).agg(F.min_by("last", order).alias("o"), F.max_by("last", order).alias("c"), F.count("*").alias("n")).collect()
    want = {(r.symbol_id, r.t): (r.o, r.c, r.n) for r in want}
    assert got and all(want[k] == x for k, x in got.items()) and len(want) - len(got) <= 3  # the open hour hasn't come yet


@pytest.mark.parametrize("mode", ["FIXED_SPREAD", "DYNAMIC_SPREAD", "MEDIAN_SPREAD"])
def test_stream_restore_is_the_batch_restore(spark, folder, mode):
    config = types.RestoreConfig(mode, 3, 2)
    run(streams.stream_restore(streams.tick_stream(spark, str(folder / "in"), SCHEMA), config), f"restored_{mode}")
    got = {(r.symbol_id, r.seq): (r.flags, round(r.bid, 6), round(r.ask, 6)) for r in spark.table(f"restored_{mode}").collect()}
    want = {(r.symbol_id, r.seq): (r.flags, round(r.bid, 6), round(r.ask, 6)) for r in spread.restore(ticks(spark), config).collect()}
    assert got == want


def test_append_and_notify(spark, folder):
    source = streams.tick_stream(spark, str(folder / "in"), SCHEMA)
    q = streams.append_hours(source, str(folder / "out"), str(folder / "c1")).start()
    q.awaitTermination()
    assert spark.read.parquet(str(folder / "out")).select("hour").distinct().count() == 5
    seen = []
    subs = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "listener int, symbol_id long")
    q = streams.notify(source, subs, lambda df, k: seen.append({r.listener: r["count"] for r in df.groupBy("listener").count().collect()}), str(folder / "c2")).start()
    q.awaitTermination()
    assert seen == [{1: 134, 2: 267}]


@pytest.mark.parametrize("mode", ["FIXED_SPREAD", "DYNAMIC_SPREAD", "MEDIAN_SPREAD"])
def test_stream_restore_over_many_batches_is_the_batch_restore(spark, tmp_path, mode):
    rows = ticks(spark, 60).withColumn("time_ms", F.col("seq") * 150_000)
    for k in range(10):
        rows.where((F.col("seq") >= 6 * k) & (F.col("seq") < 6 * k + 6)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    config = types.RestoreConfig(mode, 3, 2)
    run(streams.stream_restore(streams.tick_stream(spark, str(tmp_path / "in"), SCHEMA), config), f"many_{mode}")
    got = {(r.symbol_id, r.seq): (r.flags, round(r.bid, 6), round(r.ask, 6)) for r in spark.table(f"many_{mode}").collect()}
    want = {(r.symbol_id, r.seq): (r.flags, round(r.bid, 6), round(r.ask, 6)) for r in spread.restore(rows, config).collect()}
    assert got == want


def test_ordered_ticks(spark, tmp_path):
    rows = [(1, 0, 100, 1.0, 1.0, 16), (1, 1, 200, 1.0, 1.0, 16), (1, 2, 200, 2.0, 1.0, 16), (1, 3, 300, 2.0, 1.0, 16)], [(1, 4, 250, 3.0, 1.0, 16), (1, 5, 400, 2.5, 1.0, 16), (2, 6, 50, 1.0, 1.0, 16)]
    for part in rows:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(streams.ordered(streams.tick_stream(spark, str(tmp_path / "in"), SCHEMA)), "in_order")
    got = sorted((r.seq, r.flags) for r in spark.table("in_order").collect())
    assert got == [(0, 16), (1, 16), (3, 20), (5, 20), (6, 16)]
    query = streams.ordered(streams.tick_stream(spark, str(tmp_path / "in"), SCHEMA), on_late="raise")
    with pytest.raises(Exception, match="chronological"):
        run(query, "raised")


def test_notify_by_due_times(spark, tmp_path):
    for k, times in enumerate([(0, 400), (900, 1100), (2500, 2600), (61_000,)]):
        spark.createDataFrame([(7, 10 * k + j, t, 1.0, 1.0, 16) for j, t in enumerate(times)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    subs = spark.createDataFrame([(1, 7, 1000), (2, 7, 60_000)], "listener int, symbol_id long, period_ms long")
    seen = []
    told = lambda df, k: seen.append((k, {r.listener: r["count"] for r in df.groupBy("listener").count().collect()}))
    streams.notify(streams.tick_stream(spark, str(tmp_path / "in"), SCHEMA), subs, told, str(tmp_path / "c")).start().awaitTermination()
    assert seen == [(1, {1: 2}), (2, {1: 2}), (3, {1: 1, 2: 1})]
