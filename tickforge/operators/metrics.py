"""Per-entity window metrics over ordered sessions. All windows share one shuffle by ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sessions of the short, long and yearly frame, and the tolerance of the trend.
SHORT, LONG, YEAR, EPSILON = 7, 30, 252, 1e-9


def _sessions():
    return Window.partitionBy("ticker").orderBy("trade_date")


def _rows(n: int):
    return _sessions().rowsBetween(-(n - 1), 0)


def log_returns(bars: DataFrame) -> DataFrame:
    """Add prev_close and log_return (null without a positive previous close)."""
    prev = F.lag("close").over(_sessions())
    return bars.withColumn("prev_close", prev).withColumn("log_return", F.when(F.col("prev_close") > 0, F.ln(F.col("close") / F.col("prev_close"))))


def moving_averages(bars: DataFrame) -> DataFrame:
    out = bars.withColumn("ma_7", F.avg("close").over(_rows(SHORT))).withColumn("ma_30", F.avg("close").over(_rows(LONG)))
    return out.withColumn("avg_volume_30d", F.avg("volume").over(_rows(LONG))).withColumn("ma_30_prev", F.lag("ma_30").over(_sessions()))


def volatility(returns: DataFrame) -> DataFrame:
    """Sample standard deviation of log returns over the long frame, null with fewer than two."""
    return returns.withColumn("stddev_30d", F.stddev_samp("log_return").over(_rows(LONG)))


def yearly_range(bars: DataFrame) -> DataFrame:
    return bars.withColumn("high_52w", F.max("high").over(_rows(YEAR))).withColumn("low_52w", F.min("low").over(_rows(YEAR)))


def history_span(bars: DataFrame) -> DataFrame:
    whole = Window.partitionBy("ticker")
    return bars.withColumn("sessions_observed", F.count("*").over(whole)).withColumn("first_session", F.min("trade_date").over(whole))


def trend(now: Column, before: Column) -> Column:
    return F.when(now.isNull() | before.isNull(), F.lit(None)).when(now > before + EPSILON, "RISING").when(now < before - EPSILON, "FALLING").otherwise("FLAT")


def pct_from(value: Column, base: Column) -> Column:
    return F.when(base > 0, (value - base) / base * 100)


def enrich(bars: DataFrame) -> DataFrame:
    """Every metric for every session, unrounded."""
    return history_span(yearly_range(volatility(moving_averages(log_returns(bars)))))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest ``order`` per key, by aggregation instead of a second sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns]), order).alias("r")).select("r.*")


def ticker_metrics(bars: DataFrame) -> DataFrame:
    """One row per ticker: the snapshot of its last session, rounded for publication."""
    r4 = lambda c: F.round(c, 4)
    return latest(enrich(bars), ["ticker"], "trade_date").select(
        "ticker",
        F.col("trade_date").alias("as_of_date"),
        r4(F.col("close")).alias("latest_close"),
        r4(F.col("ma_7")).alias("ma_7"),
        r4(F.col("ma_30")).alias("ma_30"),
        r4(F.col("ma_30_prev")).alias("ma_30_prev"),
        trend(F.col("ma_30"), F.col("ma_30_prev")).alias("ma_30_trend"),
        r4(pct_from(F.col("close"), F.col("ma_30"))).alias("pct_vs_ma_30"),
        r4(F.col("stddev_30d") * F.sqrt(F.lit(float(YEAR))) * 100).alias("volatility_30d_annualised"),
        F.round("avg_volume_30d", 2).alias("avg_volume_30d"),
        r4(F.col("high_52w")).alias("high_52w"),
        r4(F.col("low_52w")).alias("low_52w"),
        r4(pct_from(F.col("close"), F.col("high_52w"))).alias("pct_from_52w_high"),
        "sessions_observed",
        "first_session",
    )
