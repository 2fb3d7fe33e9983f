"""Exact medians per key without gathering a key's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.workspace import null_safe

#: Bins per e-fold of magnitude. A key has at most a few ten thousand bins, whatever the number of its values.
_BINS = 1024


def _bin(c):
    """A non-decreasing integer function of a double: logarithmic in magnitude, mirrored for negative values."""
    offset = 800 * _BINS  # ln of the smallest double is about -745
    mag = F.floor(F.ln(F.abs(c)) * _BINS).cast("long") + offset
    return F.when(c > 0, mag).when(c < 0, -mag).otherwise(F.lit(0).cast("long"))


def grouped_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """Median of ``value`` per ``keys`` (mean of the two middle values for an even count), nulls and NaN left out.

    Result: keys, ``out`` DOUBLE, ``n`` BIGINT. Keys without any value give no row; a null key is a key.

    Pass 1 counts values per key and bin (partial aggregation, bounded state) and finds by a running count over
    bins the one or two bins that hold the middle ranks. Pass 2 counts distinct values within those bins only.
    A key with a third of all rows is therefore spread over all tasks until only its middle bin is left.
    """
    v = F.col(value).cast("double")
    vals = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("__v")).withColumn("__b", _bin(F.col("__v")))
    bins = vals.groupBy(*keys, "__b").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys)
    run = bins.withColumn("__hi", F.sum("__c").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("__c").over(w))
    r1, r2 = F.expr("(__n + 1) div 2"), F.expr("(__n + 2) div 2")
    lo = F.col("__hi") - F.col("__c")
    mid = run.where((lo < r2) & (F.col("__hi") >= r1)).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__mb"), lo.alias("__lo"), "__n")
    # equal values become one row before they meet the bin, so a value that a third of all rows have is no hot key
    counted = vals.groupBy(*keys, "__b", "__v").agg(F.count("*").alias("__c"))
    for i, k in enumerate(keys):
        cond = (F.col("__b") == F.col("__mb")) if i == 0 else cond
        cond = cond & counted[k].eqNullSafe(mid[f"__k{i}"])
    within = counted.join(mid, cond).select(*keys, "__b", "__v", "__c", "__lo", "__n")
    wb = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = within.withColumn("__hi", F.col("__lo") + F.sum("__c").over(wb)).withColumn("__from", F.col("__hi") - F.col("__c"))
    has = lambda r: (F.col("__from") < r) & (F.col("__hi") >= r)
    return ranked.groupBy(*keys).agg(
        ((F.max(F.when(has(r1), F.col("__v"))) + F.max(F.when(has(r2), F.col("__v")))) / 2).alias(out), F.first("__n").alias("n")
    )


__all__ = ["grouped_median", "null_safe"]
