"""Trade and order records: domain checks and sums over results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.types import ENUMS

DOMAINS = {
    "side": "order_side", "order_type": "order_type", "trade_mode": "trade_mode", "account_type": "account_type", "slippage_type": "slippage_type",
    "time_in_force": "time_in_force", "tp_trigger": "price_trigger", "sl_trigger": "price_trigger", "trade_state": "trade_state",
    "error_code": "trade_error", "tpsl_mode": "tp_sl_mode", "smp_type": "smp_type", "quantity_unit": "quantity_unit", "trigger_price_type": "price_trigger",
    "sl_order_type": "order_type", "tp_order_type": "order_type",
}


def invalid_fields(records: DataFrame) -> DataFrame:
    """records with `invalid`: the names of enumerated columns whose text is no member."""
    marks = [F.when(~F.col(c).isin(*ENUMS[e]), F.lit(c)) for c, e in DOMAINS.items() if c in records.columns]
    return records.withColumn("invalid", F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>"))


def results_summary(results: DataFrame, keys: Sequence[str] = ("trade_state",)) -> DataFrame:
    """Counts, profit in hundredths, commissions and mean delays of trade results."""
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    return results.groupBy(*keys).agg(
        F.count("*").alias("trades"), cents("net_pnl").alias("net_pnl_cents"), cents("gross_pnl").alias("gross_pnl_cents"),
        F.sum(F.when(F.col("net_pnl") > 0, 1).otherwise(0)).alias("wins"), F.round(F.avg("open_delay"), 6).alias("open_delay"), F.round(F.avg("close_delay"), 6).alias("close_delay"),
    )


def with_pnl(results: DataFrame) -> DataFrame:
    """net_pnl from gross_pnl and commissions, and the delays from their times."""
    return results.withColumn("net_pnl", F.col("gross_pnl") - F.col("commission_open") - F.col("commission_close")).withColumn(
        "open_delay", F.col("open_time") - F.col("place_time")
    ).withColumn("close_delay", F.col("close_time") - F.col("close_place_time"))
