"""Schemas, flags and enumerations of the market-data model. Times are milliseconds since the epoch, UTC, as LONG."""

from __future__ import annotations

from dataclasses import dataclass

# Flag bits of ticks.
BID_UPDATED, ASK_UPDATED, LAST_UPDATED, VOLUME_UPDATED, FROM_BUY, FROM_SELL, BEST_MATCH = 1, 2, 4, 8, 16, 32, 64
# Storage flag bits of ticks.
TRADE_BASED, ENABLE_TICK_FLAGS, ENABLE_RECV_TIME, TICKS_ENABLE_VOLUME, TICKS_RAW_BINARY = 1, 2, 4, 8, 32
# Status and storage flag bits of bars.
REALTIME, HISTORICAL, INCOMPLETE, FINALIZED = 1, 2, 4, 8
BID_BASED, ASK_BASED, LAST_BASED, ENABLE_VOLUME, ENABLE_QUOTE_VOLUME, ENABLE_TICK_VOLUME = 1, 2, 4, 8, 16, 32
ENABLE_BUY_VOLUME, ENABLE_BUY_QUOTE_VOLUME, ENABLE_SPREAD = 64, 128, 256
SPREAD_LAST, SPREAD_AVG, SPREAD_MAX, STORE_RAW_BINARY, FINALIZED_BARS = 512, 1024, 2048, 4096, 8192
# Kinds of data that a store can hold.
STORE_TICKS, STORE_BARS, STORE_METRICS, STORE_EVENTS, STORE_FUNDING, STORE_ORDERBOOK = 1, 2, 4, 8, 16, 32

# Names of the enumerations, in order of their numbers from 0.
ENUMS = {
    "market_type": "UNKNOWN SPOT FUTURES_PERPETUAL_LINEAR FUTURES_PERPETUAL_INVERSE FUTURES_DATED_LINEAR FUTURES_DATED_INVERSE OPTIONS_LINEAR OPTIONS_INVERSE",
    "exchange": "UNKNOWN METATRADER BINANCE BITSTAMP BYBIT COINBASE ECB GATE_IO GEMINI KRAKEN LMAX_DIGITAL BIBOX BINANCE_US BITBAY BITFINEX BITHUMB BITMEX"
    " BITTREX BTC_CHINA BTC_TRADE COINONE DERIBIT HITBTC HUOBI HUOBI_PRO ITBIT KUCOIN KUCOIN_FTS OKCOIN_CNY OKCOIN_USD OKEX POLONIEX UPBIT",
    "bid_ask_model": "NONE FIXED_SPREAD DYNAMIC_SPREAD MEDIAN_SPREAD",
    "trade_side": "Unknown Buy Sell",
    "funding_calc": "BINANCE BYBIT CUSTOM",
    "order_side": "UNKNOWN BUY SELL",
    "order_type": "UNKNOWN MARKET LIMIT STOP STOP_LIMIT",
    "time_in_force": "UNKNOWN GTC IOC FOK GTX",
    "slippage_type": "UNKNOWN ABSOLUTE_VALUE PERCENT_VALUE",
    "trade_mode": "UNKNOWN SPOT LINEAR INVERSE OPTION",
    "price_trigger": "UNKNOWN MARK_PRICE INDEX_PRICE LAST_PRICE",
    "margin_mode": "UNKNOWN CROSS ISOLATED",
    "trade_state": "UNKNOWN OPEN_PLACE OPEN_SEND OPEN_PENDING OPEN_PARTIAL OPENED ACTIVE CLOSE_PLACE CLOSE_SEND CLOSE_PENDING CLOSE_PARTIAL CLOSED"
    " CANCELED REJECTED EXPIRED CLOSE_ERROR FAILED_OPEN FAILED_CLOSE",
    "tp_sl_mode": "UNKNOWN FULL PARTIAL",
    "smp_type": "UNKNOWN CANCEL_MAKER CANCEL_TAKER CANCEL_BOTH",
    "position_idx": "UNKNOWN ONE_WAY HEDGE_BUY HEDGE_SELL",
    "quantity_unit": "UNKNOWN BASE QUOTE",
    "account_type": "UNKNOWN DEMO REAL",
    "trade_error": "SUCCESS INVALID_SYMBOL INVALID_ORDER INVALID_ACCOUNT INVALID_CURRENCY AMOUNT_TOO_LOW AMOUNT_TOO_HIGH PRICE_OUT_OF_RANGE"
    " SLIPPAGE_EXCEEDED ORDER_NOT_FILLED ORDER_PARTIALLY_FILLED ORDER_ALREADY_CLOSED ORDER_CANCELLED ORDER_REJECTED INSUFFICIENT_BALANCE"
    " INSUFFICIENT_MARGIN POSITION_NOT_FOUND POSITION_MODE_MISMATCH DUPLICATE_ORDER INVALID_TIME_IN_FORCE INVALID_STOP_PRICE RATE_LIMIT_EXCEEDED"
    " CONNECTION_ERROR SERVER_ERROR INVALID_REQUEST TIMEOUT PARSING_ERROR UNKNOWN_ERROR",
    "event_type": "TICK_UPDATE BAR_UPDATE FUNDING_UPDATE TIMER_EVENT TEST_START TEST_END REALTIME_START REALTIME_STOP",
    "storage_backend": "MDBX SQLITE",
    "transaction_mode": "READ_ONLY WRITABLE",
}
ENUMS = {k: v.split() for k, v in ENUMS.items()}
#: Enumerations whose unknown texts read as their first member; the others reject them.
LENIENT = {"market_type", "exchange"}

VALUE_TICK = "value double, time_ms long"
QUOTE_TICK = "ask double, bid double, time_ms long"
QUOTE_TICK_VOL = "ask double, bid double, volume double, time_ms long"
QUOTE_TICK_L1 = "ask double, bid double, ask_volume double, bid_volume double, time_ms long"
TRADE_TICK = "price double, volume double, time_ms long, id_and_side long"
MARKET_TICK = "time_ms long, received_ms long, ask double, bid double, last double, volume double, flags long"
OHLC_BAR = "time_ms long, open double, high double, low double, close double"
OHLCV_BAR = OHLC_BAR + ", volume double"
MARKET_BAR = OHLCV_BAR + ", quote_volume double, buy_volume double, buy_quote_volume double, spread long, tick_volume long"
SERIES_KEY = "market_type int, exchange_id int, symbol_id int"
FUNDING = "provider_id int, symbol_id int, time_ms long, funding_rate double, mark_price double, premium_index double, period_ms long"
STORE_META = "data_flags long, start_ms long, end_ms long, market_types array<int>, exchange_ids array<int>, symbol_ids array<int>"

ORDER_REQUEST = (
    "symbol string, order_link_id string, unique_id long, account_id long, side string, order_type string, trade_mode string, account_type string,"
    " currency string, quantity double, price double, trigger_price double, sl_limit_price double, tp_limit_price double, time_in_force string,"
    " reduce_only boolean, close_on_trigger boolean, sl_order_type string, tp_order_type string, trigger_price_type string, trigger_direction int,"
    " tpsl_mode string, quantity_unit string, smp_type string, mmp boolean, expiry_time long"
)
ORDER_RESULT = (
    "order_id long, exchange_order_id string, client_order_id string, error_code string, error_desc string, order_type string, trade_state string,"
    " requested_price double, executed_price double, amount double, commission double, place_time long, send_time long, exec_time long,"
    " ping_time long, delay long, order_link_id string"
)
TRADE_REQUEST = (
    "symbol string, signal_name string, user_data string, comment string, unique_hash string, unique_id long, account_id long, side string,"
    " order_type string, trade_mode string, account_type string, currency string, amount double, price double, stop_loss double, take_profit double,"
    " slippage_value double, slippage_type string, time_in_force string, reduce_only boolean, close_on_trigger boolean, tp_trigger string,"
    " sl_trigger string, hedge_mode boolean, expiry_time long"
)
TRADE_RESULT = (
    "trade_id long, exchange_trade_id string, error_code string, error_desc string, requested_price double, entry_price double,"
    " close_request_price double, exit_price double, amount double, commission_open double, commission_close double, gross_pnl double,"
    " net_pnl double, balance_before double, balance_after_open double, balance_after_close double, place_time long, send_time long,"
    " open_time long, close_place_time long, close_send_time long, close_time long, open_ping long, close_ping long, open_delay long,"
    f" close_delay long, order_requests array<struct<{ORDER_REQUEST}>>, order_results array<struct<{ORDER_RESULT}>>, trade_state string"
)


@dataclass(frozen=True)
class TickCodecConfig:
    tick_size: float = 0.0
    expiration_ms: int = 0
    next_expiration_ms: int = 0
    flags: int = 0
    price_digits: int = 0
    volume_digits: int = 0

    def has(self, flag: int) -> bool:
        return bool(self.flags & flag)


@dataclass(frozen=True)
class BarCodecConfig:
    time_frame: int = 0
    tick_size: float = 0.0
    expiration_ms: int = 0
    next_expiration_ms: int = 0
    flags: int = 0
    price_digits: int = 0
    volume_digits: int = 0
    quote_volume_digits: int = 0

    def has(self, flag: int) -> bool:
        return bool(self.flags & flag)


@dataclass(frozen=True)
class RestoreConfig:
    """mode: a name of ENUMS["bid_ask_model"]; fixed_spread in points; price_digits 0 means the codec's."""

    mode: str = "NONE"
    fixed_spread: int = 0
    price_digits: int = 0
