"""Operators against literal models."""

import random

import pytest
from pyspark.sql import functions as F

from marketloom import types
from marketloom.operators import asof, bars, bitset, blobs, catalog, codec, funding, snapshot, spread, subscriptions, trading

HOUR = 3_600_000
BARS = "symbol_id int, " + types.MARKET_BAR


def bar(sym, t, o, h, lo, c, vol=1.0, spread=0, n=1):
    return (sym, t, o, h, lo, c, vol, vol, vol, vol, spread, n)


def test_gap_fill_copies(spark):
    rows = spark.createDataFrame([bar(1, 20, 5.0, 6.0, 4.0, 5.5, spread=3), bar(1, 40, 7.0, 8.0, 6.0, 7.5, spread=4), bar(1, 5, 9.0, 9.0, 9.0, 9.0)], BARS)
    got = bars.fill_bars(rows, 10, 0, 60).orderBy("time_ms").collect()
    assert [(r.time_ms, r.open, r.close, r.volume, r.spread, r.tick_volume) for r in got] == [
        (0, 5.5, 5.5, 0.0, 3, 0), (10, 5.5, 5.5, 0.0, 3, 0), (20, 5.0, 5.5, 1.0, 3, 1), (30, 5.5, 5.5, 0.0, 3, 0), (40, 7.0, 7.5, 1.0, 4, 1), (50, 7.5, 7.5, 0.0, 4, 0),
    ]
    assert bars.fill_bars(rows.where("false"), 10, 0, 60).count() == 0


def test_gap_fill_in_place_keeps_all_bars(spark):
    rows = spark.createDataFrame([bar(1, 20, 5.0, 6.0, 4.0, 5.5), bar(1, 50, 7.0, 8.0, 6.0, 7.5)], BARS)
    got = bars.fill_bars_in_place(rows, 10, 10, 40).orderBy("time_ms").collect()
    assert [(r.time_ms, r.open, r.close) for r in got] == [(10, 5.0, 5.0), (20, 5.0, 5.5), (30, 5.5, 5.5), (40, 5.5, 5.5), (50, 7.0, 7.5)]


def test_resample_rules(spark):
    rows = spark.createDataFrame([bar(1, 0, 1.0, 3.0, 1.0, 2.0, spread=3), bar(1, 10, 2.0, 5.0, 0.5, 4.0, spread=4), bar(1, 20, 4.0, 4.0, 4.0, 4.0, spread=9)], BARS)
    on = types.ENABLE_SPREAD
    spreads = {}
    for bits in (0, on | types.SPREAD_LAST | types.SPREAD_MAX, on | types.SPREAD_MAX | types.SPREAD_AVG, on | types.SPREAD_AVG):
        got = bars.resample_bars(rows, 20, types.BarCodecConfig(flags=bits)).orderBy("time_ms").collect()
        spreads[bits] = [r.spread for r in got]
    assert list(spreads.values()) == [[0, 0], [4, 9], [4, 9], [3, 9]]
    assert (got[0].open, got[0].high, got[0].low, got[0].close, got[0].volume, got[0].tick_volume) == (1.0, 5.0, 0.5, 4.0, 2.0, 2)
    with pytest.raises(ValueError):
        bars.resample_bars(rows, 20, types.BarCodecConfig(flags=on))
    with pytest.raises(ValueError):
        bars.split_bars(rows, "W1")


def model(ticks, mode, seed, digits):
    """The restoration said tick by tick."""
    scale, out = 10**digits, []
    prev, flips, hour, median, spread_now = None, [], None, None, seed
    bid = ask = None
    for t, last, f in ticks:
        first = t // HOUR != hour
        if first:
            if hour is not None and t // HOUR != hour + 1:
                prev, flips = None, []
            hour = t // HOUR
            median = flips[-1] if flips else seed
            if prev and abs(last - prev[0]) > 1.0 / scale:
                f |= 4
        raw = f if not first else f
        if first or f & 4:
            buy = f & 16
            if prev and ((buy and prev[1] & 32 and last > prev[0]) or (not buy and prev[1] & 16 and last < prev[0])):
                flip = int(abs(last - prev[0]) * scale + 0.5) / scale
                a, b = (flips[-2] if len(flips) > 1 else seed), (flips[-1] if flips else seed)
                median = sorted((a, b, flip))[1]
                flips.append(flip)
            spread_now = {"FIXED_SPREAD": seed, "DYNAMIC_SPREAD": flips[-1] if flips else seed, "MEDIAN_SPREAD": median}[mode]
            ask, bid = (last, last - spread_now) if buy else (last + spread_now, last)
        out.append((t, f | 3 if f & 4 else f, round(bid, 6), round(ask, 6)))
        prev = (last, raw)
    return out


@pytest.mark.parametrize("mode", ["FIXED_SPREAD", "DYNAMIC_SPREAD", "MEDIAN_SPREAD"])
def test_restore_equals_the_model(spark, mode):
    rnd, t, last, data = random.Random(5), 0, 100.0, {1: [], 2: []}
    for sym in data:
        for _ in range(900):
            t += rnd.choice([1000, 20_000, 60_000, 600_000]) if rnd.random() < 0.99 else 3 * HOUR
            new = round(last + rnd.choice([-0.02, -0.01, 0, 0, 0.01, 0.02]), 2)
            data[sym].append((t, new, (16 if rnd.random() < 0.5 else 32) | (4 if new != last else 0)))
            last = new
    rows = [(s, k, t, x, f) for s, v in data.items() for k, (t, x, f) in enumerate(v)]
    df = spark.createDataFrame(rows, "symbol_id int, seq long, time_ms long, last double, flags long")
    got = spread.restore(df, types.RestoreConfig(mode, 3, 2)).collect()
    for s, v in data.items():
        mine = sorted((r.time_ms, r.flags, round(r.bid, 6), round(r.ask, 6)) for r in got if r.symbol_id == s)
        assert mine == sorted(model(v, mode, 0.03, 2))


def test_restore_needs_a_side(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0, 4)], "symbol_id int, seq long, time_ms long, last double, flags long")
    with pytest.raises(Exception, match="neither side"):
        spread.restore(df, types.RestoreConfig("FIXED_SPREAD", 3, 2)).collect()
    scaled = spread.restore(df.withColumn("flags", F.lit(20).cast("long")), types.RestoreConfig("FIXED_SPREAD", 3, 2), literal_scale=True).first()
    assert (scaled.ask, scaled.bid) == (1.0, -299.0)
    with pytest.raises(ValueError):
        spread.restore(df, types.RestoreConfig("NO SUCH", 3, 2))


@pytest.mark.parametrize("bucket", [None, 7])
def test_asof_takes_the_last_state(spark, bucket):
    rnd = random.Random(1)
    facts = [(rnd.randint(0, 2), k, rnd.randint(0, 60)) for k in range(200)]
    states = [(k, t, 10.0 * t) for k in range(2) for t in rnd.sample(range(60), 12)]
    got = asof.asof_join(spark.createDataFrame(facts, "k int, id int, time_ms long"), spark.createDataFrame(states, "k int, time_ms long, v double"), ["k"], ["v"], bucket_ms=bucket).collect()
    want = {(k, i): max((s for s in states if s[0] == k and s[1] <= t), key=lambda s: s[1], default=(0, 0, None))[2] for k, i, t in facts}
    assert {(r.k, r.id): r.v for r in got} == want


@pytest.mark.parametrize("size", [1, 10, 50, 1000])
def test_codecs_round_trip(spark, size):
    rnd = random.Random(size)
    values = [rnd.choice([0, 0, 0, rnd.randint(1, 10)]) for _ in range(size)]
    rows = spark.createDataFrame([(1, p, v) for p, v in enumerate(values)], "k int, pos long, value long").repartition(3)
    ways = {
        "delta": lambda: codec.undelta(codec.delta(rows, ["k"], 5), ["k"], 5),
        "zigzag": lambda: codec.undelta_zigzag(codec.delta_zigzag(rows, ["k"]), ["k"]),
        "chunks": lambda: codec.undelta_chunked(codec.delta_chunked(rows, ["k"], 8), ["k"], 8),
        "frequency": lambda: codec.frequency_decode(codec.frequency_encode(rows, ["k"]), codec.frequency_codes(rows, ["k"]), ["k"]),
        "zeros": lambda: codec.unzero_runs(codec.zero_runs(rows, ["k"]), ["k"]),
        "runs": lambda: codec.unruns(codec.run_lengths(rows, ["k"], 3), ["k"]),
        "vbyte": lambda: codec.from_blob(codec.to_blob(rows, ["k"], "vbyte"), ["k"], "vbyte"),
        "bits": lambda: codec.from_blob(codec.to_blob(rows, ["k"], "bits"), ["k"], "bits"),
    }
    for name, way in ways.items():
        assert [r.value for r in way().orderBy("pos").collect()] == values, name


def test_zero_runs_code(spark):
    rows = spark.createDataFrame([(1, p, v) for p, v in enumerate([0, 0, 5, 0, 0, 0, 1])], "k int, pos long, value long")
    assert [r.value for r in codec.zero_runs(rows, ["k"]).orderBy("pos").collect()] == [5, 10, 0, 5, 2]
    with pytest.raises(Exception, match="times fall"):
        codec.delta_sorted(spark.createDataFrame([(1, 0, 5), (1, 1, 4)], "k int, pos long, value long"), ["k"]).collect()
    with pytest.raises(Exception, match="too large"):
        codec.scale_volume(spark.createDataFrame([(1, 0, 5e9)], "k int, pos long, value double"), 0, 32).collect()


@pytest.mark.parametrize("size,a,b", [(8, {0, 2, 4}, {1, 2, 3}), (64, {0, 63}, {1, 62}), (96, {0, 64, 95}, {1, 65, 94}), (130, {0, 64, 129}, {1, 65, 128})])
def test_bitsets(spark, size, a, b):
    x, y = (spark.createDataFrame([(p,) for p in s], "pos long") for s in (a, b))
    got = lambda df: {r.pos for r in df.collect()}
    assert got(bitset.either(x, y)) == a | b and got(bitset.both(x, y)) == a & b
    assert got(bitset.shift_left(x, 2, size)) == {p + 2 for p in a if p + 2 < size} and got(bitset.shift_right(y, 1)) == {p - 1 for p in b}
    assert got(bitset.put(x, 5, size)) == a | {5} and got(bitset.reset(x, 0, size)) == a - {0} and bitset.is_set(x, 0, size)
    with pytest.raises(IndexError):
        bitset.put(x, size, size)


def test_bus_update(spark):
    subs = spark.createDataFrame([(1, 7, 0, 10), (2, 8, 0, 25)], "listener int, symbol_id int, provider_id int, period_ms long")
    ticks = spark.createDataFrame([(s, t, t, 1.0) for s in (7, 8) for t in range(0, 60, 5)], "symbol_id int, seq long, time_ms long, last double")
    due = {10: 10, 25: 25}
    sent, due = subscriptions.update(subs, ticks, 0, 9, due)
    assert sent.count() == 0 and due == {10: 10, 25: 25}
    sent, due = subscriptions.update(subs, ticks, 0, 11, due)
    assert {r.listener: r.ticks for r in sent.collect()} == {1: 3} and due == {10: 20, 25: 25}
    sent, due = subscriptions.update(subs, ticks, 11, 50, due)
    assert {r.listener: r.ticks for r in sent.collect()} == {1: 7, 2: 7} and due == {10: 60, 25: 75}
    hourly = spark.createDataFrame([(1, 7, 0, 1000), (2, 7, 0, 3_600_000)], "listener int, symbol_id int, provider_id int, period_ms long")
    sent, due = subscriptions.update(hourly, ticks, 0, 2500, {1000: 1000, 3_600_000: 3_600_000})  # over two due times of one period
    assert {r.listener: r.ticks for r in sent.collect()} == {1: 12} and due == {1000: 3000, 3_600_000: 3_600_000}
    with pytest.raises(Exception, match="positive"):
        subscriptions.timer_groups(subs.withColumn("period_ms", F.lit(0).cast("long"))).collect()


def test_funding_upserts(spark):
    held = spark.createDataFrame([(1, 1, 0, 0.1), (1, 1, 10, 0.2)], "provider_id int, symbol_id int, time_ms long, funding_rate double")
    new = spark.createDataFrame([(1, 1, 10, 0.3, 1), (1, 1, 10, 0.4, 2), (2, 1, 10, 0.5, 3)], "provider_id int, symbol_id int, time_ms long, funding_rate double, written int")
    got = {(r.provider_id, r.time_ms): r.funding_rate for r in funding.insert_or_replace(held, new).collect()}
    assert got == {(1, 0): 0.1, (1, 10): 0.4, (2, 10): 0.5}
    half = spark.createDataFrame([(1, 1, HOUR // 2 - 1, 1.0), (1, 1, HOUR // 2, 2.0), (1, 1, HOUR, 3.0)], "provider_id int, symbol_id int, time_ms long, funding_rate double")
    assert {r.hour: r.funding_rate for r in funding.latest_by_hour(half).collect()} == {0: 1.0, 1: 3.0}


def test_routing_takes_the_first_and_open_bounds(spark):
    schema = "store string, priority int, " + types.STORE_META
    stores = spark.createDataFrame([("a", 0, 2, 100, 200, [1], [1], [5]), ("b", 1, 2, 0, 0, [1], [1], [5, 6]), ("c", 2, 1, 0, 0, [1], [1], [9])], schema)
    asks = spark.createDataFrame([(1, 1, 1, 5, 150), (2, 1, 1, 5, 200), (3, 1, 1, 6, 1)], "request_id int, market_type int, exchange_id int, symbol_id int, time_ms long")
    assert {r.request_id: r.store for r in catalog.route(asks, stores, types.STORE_BARS).collect()} == {1: "a", 2: "b", 3: "b"}
    with pytest.raises(Exception, match="no store"):
        catalog.route(asks.withColumn("symbol_id", F.lit(9)), stores, types.STORE_BARS).collect()


def test_routing_makes_no_product_of_sets(spark):
    many = 3000
    stores = spark.createDataFrame([("a", 0, 2, 0, 0, list(range(8)), list(range(1000)), list(range(many)))], "store string, priority int, " + types.STORE_META)
    asks = spark.range(many + 1).select(F.col("id").alias("request_id"), (F.col("id") % 8).cast("int").alias("market_type"), (F.col("id") % 1000).cast("int").alias("exchange_id"), F.col("id").cast("int").alias("symbol_id"), F.lit(5).cast("long").alias("time_ms"))
    held = asks.where(F.col("symbol_id") < many).withColumns({"store": F.lit("a"), "priority": F.lit(0)})
    held = held.unionByName(held.limit(1).withColumn("time_ms", F.lit(9).cast("long"))).drop("request_id")
    for out in (catalog.route(asks, stores, types.STORE_BARS, strict=False), catalog.route_held(asks, held, strict=False)):
        assert out.where("store = 'a'").count() == many and out.where("store IS NULL").count() == 1


def test_unchanged_metadata_is_not_written(spark):
    held = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    after, changed = catalog.put_changed(held, spark.createDataFrame([(1, 5), (2, 7), (3, 8)], "k int, v int"), ["k"])
    assert {tuple(r) for r in after.collect()} == {(1, 5), (2, 7), (3, 8)} and {tuple(r) for r in changed.collect()} == {(2, 7), (3, 8)}


def test_record_domains(spark):
    rows = spark.createDataFrame([("BUY", "MARKET"), ("?", "NOPE")], "side string, order_type string")
    assert [sorted(r.invalid) for r in trading.invalid_fields(rows).collect()] == [[], ["order_type", "side"]]
    spark.createDataFrame([], types.TRADE_RESULT)
    spark.createDataFrame([], types.TRADE_REQUEST)


def test_blobs(spark):
    i = F.col("id")
    ticks = spark.range(32).select(F.lit(1).alias("k"), (1_700_000_000_000 + i * 100).alias("time_ms"), F.lit(0).cast("long").alias("received_ms"), (100.25 + 0.01 * i).alias("ask"), (100.2 + 0.01 * i).alias("bid"), (100.22 + 0.01 * i).alias("last"), (i % 3 - 1.0).alias("volume"), (i % 2 * 16 + 16).alias("flags"))
    got = blobs.deserialize(blobs.serialize(ticks, ["k"], "ticks", types.TickCodecConfig(flags=types.TICKS_RAW_BINARY)), ["k"], "ticks")
    assert got.exceptAll(ticks.select(*got.columns)).isEmpty() and got.count() == 32
    config = types.TickCodecConfig(flags=types.TRADE_BASED | types.ENABLE_TICK_FLAGS, price_digits=6, volume_digits=3)
    many = ticks.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(40))))
    packed = blobs.serialize(many, ["k"], "ticks", config)
    assert {blobs.num_samples(bytes(r.blob)) for r in packed.collect()} == {32}
    raw = blobs.serialize(many.withColumn("last", F.col("last") + F.col("k")), ["k"], "ticks", types.TickCodecConfig(flags=types.TICKS_RAW_BINARY))
    kept = blobs.train_dictionary(raw, size=2000)
    back = blobs.deserialize(blobs.serialize(ticks, ["k"], "ticks", config, kept), ["k"], "ticks", kept).orderBy("time_ms").collect()
    assert [(r.time_ms, round(r.last, 6), r.volume, r.flags) for r in back] == [(r.time_ms, round(r.last, 6), r.volume, r.flags) for r in ticks.orderBy("time_ms").collect()]
    with pytest.raises(ValueError):
        blobs.serialize(ticks, ["k"], "ticks", types.TickCodecConfig())
    with pytest.raises(Exception, match="signature"):
        blobs.deserialize(spark.createDataFrame([(1, bytearray(b"\x09"))], "k int, blob binary"), ["k"], "ticks").collect()


def test_snapshot_view(spark):
    ticks = spark.createDataFrame([(0, 1, k, 10 * k, 1.0 * k) for k in range(6)], "provider_id int, symbol_id int, seq long, time_ms long, last double")
    rates = spark.createDataFrame([(0, 1, 5, 0.1, 9.0), (0, 1, 30, 0.2, 8.0), (0, 1, 99, 0.3, 7.0)], "provider_id int, symbol_id int, time_ms long, funding_rate double, mark_price double")
    s = snapshot.Snapshot(ticks, 40, 10, rates, ["X", "Y"], ["A"])
    assert (s.tick().first().last, s.tick(1).first().last, s.counts().first().ticks, s.ticks(symbol=1, provider=0).count()) == (4.0, 3.0, 4, 4)
    assert (s.funding().first().funding_rate, s.index("symbol", "Y"), s.name("provider", 0)) == (0.2, 1, "A")
    with pytest.raises(KeyError):
        s.index("symbol", "Z")


def test_small_tools(spark):
    meta = {"data_flags": 3, "start_ms": 5, "end_ms": 2**40, "symbol_ids": [1, 65535], "exchange_ids": [], "market_types": [7]}
    assert catalog.unpack_metadata(catalog.pack_metadata(meta)) == meta
    with pytest.raises(Exception):
        catalog.unpack_metadata(catalog.pack_metadata(meta)[:-1])
    subs = spark.createDataFrame([(1, 7, 0, 10), (1, 8, 0, 10), (2, 8, 0, 25)], "listener int, symbol_id int, provider_id int, period_ms long")
    assert sorted(r.listener for r in subscriptions.start(subs, 5).collect()) == [1, 2]
    assert subscriptions.unsubscribe(subs, subs.where("symbol_id = 8")).count() == 1
    row = spark.createDataFrame([bar(1, 0, 1.0, 2.0, 0.5, 1.5)], BARS)
    assert bars.project(row, types.OHLCV_BAR, ["symbol_id"]).columns == ["symbol_id", "time_ms", "open", "high", "low", "close", "volume"]
