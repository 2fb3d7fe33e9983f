"""Declared schemas and constraints of the layered tables. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def _struct(*fields: tuple) -> T.StructType:
    """Fields as (name, type) for nullable ones and (name, type, False) for required ones."""
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


BRONZE = _struct(
    ("raw_payload", _S, False), ("source_file", _S, False), ("payload_bytes", _I, False),
    ("ingest_ts", T.TimestampType(), False), ("ingest_date", T.DateType(), False), ("batch_id", _S, False),
)

PAYLOAD = _struct(
    ("ticker", _S), ("trade_date", _S), ("open", _D), ("high", _D), ("low", _D), ("close", _D),
    ("adj_close", _D), ("volume", _L), ("source", _S), ("event_ts", _S),
)

SILVER = _struct(
    ("ticker", _S, False), ("trade_date", T.DateType(), False), ("open", _D, False), ("high", _D, False), ("low", _D, False),
    ("close", _D, False), ("adj_close", _D), ("volume", _L, False), ("source", _S), ("event_ts", T.TimestampType()),
    ("ingest_ts", T.TimestampType(), False), ("batch_id", _S, False),
)

GOLD = _struct(
    ("ticker", _S, False), ("as_of_date", T.DateType(), False), ("latest_close", _D, False), ("ma_7", _D), ("ma_30", _D),
    ("ma_30_prev", _D), ("ma_30_trend", _S), ("pct_vs_ma_30", _D), ("volatility_30d_annualised", _D), ("avg_volume_30d", _D),
    ("high_52w", _D), ("low_52w", _D), ("pct_from_52w_high", _D), ("sessions_observed", _L, False), ("first_session", T.DateType()),
    ("updated_at", T.TimestampType(), False),
)

#: Stored constraints of the typed table.
SILVER_CHECKS = {
    "positive_prices": "open > 0 AND high > 0 AND low > 0 AND close > 0",
    "volume_not_negative": "volume >= 0",
    "high_not_below_low": "high >= low",
    "high_spans_open_close": "high >= greatest(open, close)",
    "low_spans_open_close": "low <= least(open, close)",
}

REQUIRED = ("ticker", "trade_date", "open", "high", "low", "close", "volume")
