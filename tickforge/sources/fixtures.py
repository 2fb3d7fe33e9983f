"""Weekly bars per supplier nation from the driver's star schema; they stand in for quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.workspace import read


def bars(spark: SparkSession, d: str) -> DataFrame:
    """ticker, trade_date, open, high, low, close, volume. First and last tick by a total order, found by aggregation."""
    items, suppliers, nations = read(spark, d, "lineitem"), read(spark, d, "supplier"), read(spark, d, "nation")
    tick = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    j = items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    px = F.col("l_extendedprice") / F.col("l_quantity")
    t = j.select(
        F.concat(F.lit("T"), F.char((F.col("n_nationkey") + 65).cast("bigint"))).alias("ticker"),
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("trade_date"), px.alias("px"), F.col("l_quantity").alias("qty"), tick.alias("tick"),
    )
    return t.groupBy("ticker", "trade_date").agg(
        F.min_by("px", "tick").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "tick").alias("close"), F.sum("qty").cast("bigint").alias("volume")
    )
