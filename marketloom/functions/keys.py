"""Packed keys. A key of 64 bits is negative for market types from 4 on; order and filter by its components, not by it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Widths in bits of the fields, from the top.
MARKET_BITS, EXCHANGE_BITS, SYMBOL_BITS, SEGMENT_BITS = 3, 10, 16, 35
SIDE_BITS, TRADE_ID_BITS = 3, 61
WIDTHS = {"market_type": MARKET_BITS, "exchange_id": EXCHANGE_BITS, "symbol_id": SYMBOL_BITS, "segment": SEGMENT_BITS}


def _field(key: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def symbol_key32(market: Column, exchange: Column, symbol: Column) -> Column:
    m, e, s = (x.cast("long") for x in (market, exchange, symbol))
    return F.shiftleft(m, EXCHANGE_BITS + SYMBOL_BITS).bitwiseOR(F.shiftleft(e, SYMBOL_BITS)).bitwiseOR(s)


def symbol_key64(market: Column, exchange: Column, symbol: Column, segment: Column) -> Column:
    """An error where a field is wider than its bits, as it would change its neighbours; `wide_key64` takes such fields."""
    key = F.shiftleft(symbol_key32(market, exchange, symbol), SEGMENT_BITS).bitwiseOR(segment.cast("long"))
    wide = reduce(Column.__or__, [high != 0 for high in _high(market, exchange, symbol, segment)])
    return F.when(wide, F.raise_error(F.lit("a field is wider than its bits in the key")).cast("long")).otherwise(key)


def _high(*fields: Column) -> list[Column]:
    """What of market, exchange, symbol and segment lies above their bits."""
    return [F.shiftright(x.cast("long"), bits) for x, bits in zip(fields, WIDTHS.values())]


def wide_key64(market: Column, exchange: Column, symbol: Column, segment: Column) -> Column:
    """key, over: the key of the fields' low bits, and what lies above them, null where all fit; `wide_key64_fields` restores fields of any width."""
    fields = market, exchange, symbol, segment
    low = [x.cast("long").bitwiseAND(F.lit((1 << bits) - 1)) for x, bits in zip(fields, WIDTHS.values())]
    high = _high(*fields)
    over = F.when(reduce(Column.__or__, [x != 0 for x in high]), F.struct(*(x.alias(n) for n, x in zip(WIDTHS, high))))
    return F.struct(F.shiftleft(symbol_key32(*low[:3]), SEGMENT_BITS).bitwiseOR(low[3]).alias("key"), over.alias("over"))


def key32_fields(key: Column) -> dict[str, Column]:
    key = key.cast("long")
    return {
        "market_type": _field(key, EXCHANGE_BITS + SYMBOL_BITS, MARKET_BITS).cast("int"),
        "exchange_id": _field(key, SYMBOL_BITS, EXCHANGE_BITS).cast("int"),
        "symbol_id": _field(key, 0, SYMBOL_BITS).cast("int"),
    }


def key64_fields(key: Column) -> dict[str, Column]:
    return key32_fields(F.shiftrightunsigned(key, SEGMENT_BITS)) | {"segment": _field(key, 0, SEGMENT_BITS)}


def wide_key64_fields(wide: Column) -> dict[str, Column]:
    def whole(name: str, low: Column) -> Column:
        high = F.shiftleft(F.coalesce(wide["over"][name], F.lit(0).cast("long")), WIDTHS[name])
        return high.bitwiseOR(low.cast("long")).cast("long" if name == "segment" else "int")

    return {n: whole(n, low) for n, low in key64_fields(wide["key"]).items()}


def pack_trade_id(trade_id: Column, side: Column) -> Column:
    return F.shiftleft(trade_id.cast("long"), SIDE_BITS).bitwiseOR(side.cast("long"))


def unpack_trade_id(packed: Column) -> dict[str, Column]:
    return {"trade_id": F.shiftrightunsigned(packed, SIDE_BITS), "side": _field(packed, 0, SIDE_BITS).cast("int")}


def data_index(provider: Column, symbol: Column, symbols: Column | int) -> Column:
    """Place in a table of providers by symbols; an error outside it."""
    n = F.lit(symbols) if isinstance(symbols, int) else symbols
    return F.when((symbol >= 0) & (symbol < n) & (provider >= 0), provider * n + symbol).otherwise(F.raise_error(F.lit("index out of range")).cast("long"))
