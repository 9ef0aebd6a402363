import pytest
from pyspark.sql import functions as F

from marketloom import types
from marketloom.functions import fixedpoint, flags, funding, keys, timeframe


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_keys_at_their_bounds(spark):
    rows = spark.createDataFrame([(7, 1023, 65535, 2**35 - 1), (0, 0, 0, 0), (4, 1, 2, 3)], "m int, e int, s int, g long")
    key = keys.symbol_key64(*(F.col(c) for c in "mesg"))
    back = rows.select("*", key.alias("key")).select("m", "e", "s", "g", *(c.alias(n) for n, c in keys.key64_fields(F.col("key")).items()), "key").collect()
    assert all(tuple(r)[:4] == tuple(r)[4:8] for r in back)
    assert back[0].key == -1 and back[1].key == 0


def test_keys_of_wide_fields(spark):
    rows = [(7, 1023, 65535, 2**35 - 1), (3, 5, 120_000, 950_300_000), (9, 1024, 2**31 - 1, 2**62), (1, 1, -1, -5)]
    df = spark.createDataFrame(rows, "m int, e int, s int, g long")
    wide = df.select(keys.wide_key64(*(F.col(c) for c in "mesg")).alias("k"))
    back = wide.select(*(c.alias(n) for n, c in keys.wide_key64_fields(F.col("k")).items()), "k").collect()
    assert [tuple(r)[:4] for r in back] == rows and back[0].k.key == -1 and back[0].k.over is None and back[1].k.over.symbol_id == 1
    with pytest.raises(Exception, match="wider than its bits"):
        df.where("s = 120000").select(keys.symbol_key64(*(F.col(c) for c in "mesg"))).collect()


def test_key_round_trip_beyond_16_bits(spark, sf, tmp_path):
    from marketloom.plans.queries import QUERIES

    spark.read.parquet(f"{sf}/part.parquet").withColumn("p_partkey", F.col("p_partkey") + 70_000).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = {tuple(r) for r in QUERIES["key64_round_trip"](spark, str(tmp_path)).select("market_type", "exchange_id", "symbol_id", "segment").collect()}
    want = {(k % 8, k % 33, k, k * 7919 + 20_000) for (k,) in spark.read.parquet(str(tmp_path / "part.parquet")).select("p_partkey").collect()}
    assert got == want


def test_trade_ids_use_61_bits(spark):
    packed = keys.pack_trade_id(F.lit(2**61 - 1), F.lit(2))
    got = keys.unpack_trade_id(packed)
    assert one(spark, got["trade_id"], got["side"]) == (2**61 - 1, 2)


def test_data_index_rejects_what_lies_outside(spark):
    assert one(spark, keys.data_index(F.lit(2), F.lit(3), 10)) == (23,)
    with pytest.raises(Exception, match="index out of range"):
        one(spark, keys.data_index(F.lit(2), F.lit(10), 10))


def test_rounding_is_half_away_from_zero(spark):
    assert one(spark, *(fixedpoint.normalize(F.lit(x), 2) for x in (0.125, -0.125, 2.5))) == (0.13, -0.13, 2.5)
    with pytest.raises(ValueError):
        fixedpoint.power10(19)


def test_digits_and_comparison(spark):
    assert one(spark, *(fixedpoint.count_digits(F.lit(x)) for x in ("1.250", "3", "0.1"))) == (3, 0, 1)
    assert one(spark, fixedpoint.compare(F.lit(1.0), F.lit(1.001), 3), fixedpoint.compare(F.lit(1.0), F.lit(1.01), 3)) == (True, False)
    assert one(spark, *(fixedpoint.median3(*(F.lit(x) for x in t)) for t in ((1, 2, 3), (3, 1, 2), (2, 2, 9)))) == (2, 2, 2)


def test_frames(spark):
    lower = {s: one(spark, timeframe.lower_timeframe(F.lit(s)))[0] for s in (86400, 60, 3, 1, 604800)}
    assert lower == {86400: 14400, 60: 15, 3: 1, 1: 0, 604800: 0}
    ms = {x: one(spark, timeframe.lower_interval_ms(F.lit(x)))[0] for x in (86_400_000, 5000, 3000, 1000, 7_200_000, 45_000, 999)}
    assert ms == {86_400_000: 14_400_000, 5000: 0, 3000: 0, 1000: 0, 7_200_000: 3_600_000, 45_000: 15_000, 999: 0}
    assert one(spark, timeframe.to_timeframe_ms(F.lit(60000)), timeframe.to_timeframe_ms(F.lit(60001)), timeframe.to_timeframe(F.lit(7))) == (60, 0, 0)
    with pytest.raises(Exception, match="no segment"):
        one(spark, timeframe.segment_ms(F.lit(604800)))


def test_enumerations(spark):
    assert one(spark, flags.enum_name(F.lit(2), "market_type"), flags.enum_number(F.lit("SPOT"), "market_type"), flags.enum_number(F.lit("?"), "market_type")) == ("FUTURES_PERPETUAL_LINEAR", 1, 0)
    with pytest.raises(Exception, match="invalid order_side"):
        one(spark, flags.enum_number(F.lit("?"), "order_side"))
    assert [len(types.ENUMS[k]) for k in ("market_type", "exchange", "trade_state", "trade_error")] == [8, 33, 18, 28]


def test_funding_rules(spark):
    args = [F.lit(x) for x in (0.01, 2.0, 100.0, 0.5, 14_400_000.0)]
    got = one(spark, funding.payment("BINANCE")(*args), funding.payment("BYBIT")(*args), funding.payment("CUSTOM")(*args))
    assert got == pytest.approx((0.01 * 1.5 * 200 / 2, 0.51 * 200 / 2, 2.0))
    assert one(spark, funding.default_payment(F.lit(0.01), F.lit(50.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == (0.5,)
    funding.register("DOUBLE", lambda r, s, m, p, t: r * s * 2)
    assert one(spark, funding.payment("DOUBLE")(*args)) == (0.04,)
    with pytest.raises(ValueError):
        funding.payment("NONE SUCH")
