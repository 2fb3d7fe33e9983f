"""Column-level quality profile: declarative checks compiled into one aggregate scan, with mergeable states per load.

``compile_profile`` turns a list of column checks into aggregates: counts, conditional counts, a distinct-count sketch
and a quantile sketch. ``load_states`` runs them all in one pass with one state per load. States merge: the counts add
up and the sketches unite. ``ProfileStore`` keeps them: a delivery is scanned once, its states are merged with those that
the store has of the same loads (``merge_states``) and all others stay as they are. ``find_issues`` compares each load's
metrics, which come from stored states only, with the usual ones of its feed (control limits around the median over the
feed's loads) and with counts that a gate recorded.

The sketches are exact below their size: up to ``QUANTILE_K`` values per load and column for medians, and as good as
exact up to ``EXACT_DISTINCT`` distinct values; beyond that the rank error is about 1.65 / QUANTILE_K, the distinct
count's about 1.04 / sqrt(2**DISTINCT_LG_K). Their size is fixed, so a load with a third of all rows needs no more memory.
Where such an error could decide a test, ``recheck`` counts that load and column exactly, from its rows.

Defined cases: a null batch_id is a load of its own; a load's feed is its most frequent non-null source, the smallest
name in a tie, null if there is none (such loads form a feed); shares over no value are null and give no issue; NaN is
not above 0 and takes no part in medians; repeated rows count as often as they stand there.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.functions.scalars import TICKER_PATTERN
from tickforge.operators.quantiles import grouped_median
from tickforge.operators.tables import VersionedTable
from tickforge.workspace import written

QUANTILE_K, EXACT_DISTINCT = 4096, 1000
DISTINCT_LG_K = 14
#: Twice the sketches' errors: of ranks, and relative of distinct counts.
RANK_MARGIN, DISTINCT_MARGIN = 0.001, 0.03


@dataclass(frozen=True)
class ColumnCheck:
    """What to measure of a column. ``low``: the least valid value, itself invalid if ``strict``; ``pattern``: for strings."""

    column: str
    numeric: bool = False
    low: float | None = None
    strict: bool = False
    pattern: str | None = None

    def out_of_range(self) -> Column | None:
        if self.low is None:
            return None
        c = F.col(f"`{self.column}`")
        return F.isnan(c.cast("double")) | (c <= self.low if self.strict else c < self.low)


QUOTE_CHECKS = (
    ColumnCheck("ticker", pattern=TICKER_PATTERN),
    ColumnCheck("trade_date"),
    *[ColumnCheck(c, numeric=True, low=0, strict=True) for c in ("open", "high", "low", "close", "adj_close")],
    ColumnCheck("volume", numeric=True, low=0),
    ColumnCheck("event_ts"),
)
#: Columns of the report; the others only serve the comparison with recorded counts.
REPORTED = ("ticker", "open", "high", "low", "close", "adj_close", "volume", "event_ts")


def compile_profile(checks: Iterable[ColumnCheck]) -> list[Column]:
    out = [F.count("*").alias("rows")]
    for k in checks:
        c = F.col(f"`{k.column}`")
        out.append(F.count_if(c.isNull()).alias(f"nulls_{k.column}"))
        out.append(F.hll_sketch_agg(c.cast("string"), F.lit(DISTINCT_LG_K)).alias(f"distinct_{k.column}"))
        if k.pattern:
            out.append(F.count_if(~c.rlike(k.pattern)).alias(f"unmatched_{k.column}"))
        if (bad := k.out_of_range()) is not None:
            out.append(F.count_if(bad).alias(f"outside_{k.column}"))
        if k.numeric:
            d = c.cast("double")
            out.append(F.kll_sketch_agg_double(F.when(~F.isnan(d), d), F.lit(QUANTILE_K)).alias(f"quantiles_{k.column}"))
    return out


def load_states(df: DataFrame, checks=QUOTE_CHECKS, load: str = "batch_id", feed: str = "source") -> DataFrame:
    """One mergeable state per load, in one scan, and the load's feed."""
    return df.groupBy(F.col(load).alias("batch_id")).agg(F.mode(F.col(f"`{feed}`"), True).alias("feed"), *compile_profile(checks))


class ProfileStore:
    """States of loads, in ``BUCKETS`` by a hash of the load, and beside them how often each load has each source."""

    BUCKETS = 8
    SOURCES = T.StructType([T.StructField("batch_id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n", T.LongType()), T.StructField("__bucket", T.StringType())])

    def __init__(self, spark: SparkSession, path: str, checks=QUOTE_CHECKS):
        self.table, self.checks = VersionedTable(spark, path), checks

    def deliver(self, df: DataFrame, load: str = "batch_id", feed: str = "source") -> dict:
        """Scan a delivery and merge its states in; one commit. Returns its metrics."""
        bucket = F.pmod(F.xxhash64("batch_id"), F.lit(self.BUCKETS)).cast("string").alias("__bucket")
        rows = df.select(F.col(f"`{load}`").cast("string").alias("batch_id"), F.col(f"`{feed}`").alias("source"), *[F.col(f"`{k.column}`") for k in self.checks])
        states = rows.groupBy("batch_id").agg(*compile_profile(self.checks)).select("*", bucket)
        if not self.table.exists():
            self.table.create(T.StructType([T.StructField(f.name, f.dataType, True) for f in states.schema]), partition_by="__bucket")
        base = self.table.manifest()
        fresh = self.table._write(states, "__bucket")
        new = self.table._open(fresh, self.table.schema)
        near = sorted(fresh.keys() & base["parts"].keys())
        known = self.table.read(base["version"], near) if near else None
        again = known.join(new.select(F.col("batch_id").alias("__b")).distinct(), F.col("batch_id").eqNullSafe(F.col("__b")), "left_semi").select("__bucket").distinct().collect() if near else []  # names of buckets
        hit = sorted(r[0] for r in again)
        if hit:
            both = self.table.read(base["version"], hit).unionByName(new.where(F.col("__bucket").isin(hit)))
            merged = self.table._write(merge_states(both, ["batch_id", "__bucket"]).select(new.columns), "__bucket")
            fresh = {p: d for p, d in fresh.items() if p not in hit} | merged
        counts = rows.where(F.col("source").isNotNull()).groupBy("batch_id", "source").agg(F.count("*").alias("n")).select("*", bucket)
        metrics = {"buckets": len(fresh), "mergedBuckets": len(hit)}
        self.table.put(base, "DELIVER", metrics, added=fresh, dropped=hit, side={"sources": (self.table._write(counts, "__bucket"), ())})
        return metrics

    def states(self) -> DataFrame:
        """One row per load with its feed: the columns of ``load_states``."""
        n = self.table.read_side("sources", self.SOURCES).groupBy("batch_id", "source").agg(F.sum("n").alias("n"))
        first = n.groupBy(F.col("batch_id").alias("__b")).agg(F.min_by("source", F.struct(-F.col("n"), "source")).alias("feed"))
        return self.table.read().join(first, F.col("batch_id").eqNullSafe(F.col("__b")), "left").drop("__b", "__bucket")


def merge_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """Unite states, for example of the parts of a load or of all loads of a feed."""
    out = []
    for c in states.columns:
        if c in keys or c in ("feed", "batch_id", "__bucket"):
            continue
        if c.startswith("distinct_"):
            out.append(F.hll_union_agg(c).alias(c))
        elif c.startswith("quantiles_"):
            out.append(F.kll_merge_agg_double(c).alias(c))
        else:
            out.append(F.sum(c).alias(c))
    return states.groupBy(*keys).agg(*out)


def _sketch_median(sketch: Column) -> Column:
    """Mean of the two middle values. The rank must be a literal: just above one half it is the upper middle one, as
    long as the sketch is exact."""
    at = lambda r: F.kll_sketch_get_quantile_double(sketch, F.lit(r))
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, (at(0.5) + at(0.5001)) / 2)


def _near_median(sketch: Column, rank: float) -> Column:
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(rank)))


def load_metrics(states: DataFrame, checks=QUOTE_CHECKS) -> DataFrame:
    """One row per load and column: the metrics of the profile."""
    none = F.lit(None)
    items = []
    for k in checks:
        n = F.col("rows") - F.col(f"nulls_{k.column}")
        items.append(
            F.struct(
                F.lit(k.column).alias("column_name"),
                (F.col(f"nulls_{k.column}") / F.col("rows")).alias("null_share"),
                F.hll_sketch_estimate(f"distinct_{k.column}").alias("distinct_values"),
                F.when(n > 0, (F.col(f"unmatched_{k.column}") if k.pattern else none) / n).cast("double").alias("unmatched_share"),
                F.when(n > 0, (F.col(f"outside_{k.column}") if k.low is not None else none) / n).cast("double").alias("outside_share"),
                (_sketch_median(F.col(f"quantiles_{k.column}")) if k.numeric else none).cast("double").alias("median_value"),
                (_near_median(F.col(f"quantiles_{k.column}"), 0.5 - RANK_MARGIN) if k.numeric else none).cast("double").alias("median_low"),
                (_near_median(F.col(f"quantiles_{k.column}"), 0.5 + RANK_MARGIN) if k.numeric else none).cast("double").alias("median_high"),
                F.col(f"nulls_{k.column}").alias("null_rows"),
                (F.col(f"outside_{k.column}") if k.low is not None else none).cast("long").alias("outside_rows"),
            )
        )
    return states.select("batch_id", "feed", "rows", F.explode(F.array(*items)).alias("m")).select("batch_id", "feed", "rows", "m.*")


def profile_with_usual(metrics: DataFrame) -> DataFrame:
    """Add the usual metrics of the feed: medians over all its loads."""
    out = metrics
    names = ("null_share", "unmatched_share", "distinct_values", "median_value")
    long = metrics.select("feed", F.col("column_name"), F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])).alias("x")).select("feed", "column_name", "x.metric", "x.v")
    usual = grouped_median(long, ["feed", "column_name", "metric"], "v", "usual")
    wide = usual.groupBy(F.col("feed").alias("u_feed"), F.col("column_name").alias("u_column")).agg(*[F.max(F.when(F.col("metric") == n, F.col("usual"))).alias(f"usual_{n}") for n in names])
    return out.join(wide, F.col("feed").eqNullSafe(F.col("u_feed")) & (F.col("column_name") == F.col("u_column")), "left").drop("u_feed", "u_column")


def recorded_miscounts(metrics: DataFrame, gate: DataFrame) -> DataFrame:
    """batch_id, column_name where a recorded non-null unexpected_count isn't the number of rows that break that
    expectation. Expectations of other kinds and on unknown loads are not compared."""
    by_rule = F.when(F.col("expectation").endswith("to_not_be_null"), F.col("null_rows")).when(F.col("expectation").endswith("to_be_between"), F.col("outside_rows"))
    g = gate.where(F.col("unexpected_count").isNotNull()).select(F.col("batch_id").alias("g_batch"), F.col("column_name").alias("g_column"), "expectation", "unexpected_count").distinct()
    j = g.join(metrics, (F.col("g_batch") == F.col("batch_id")) & (F.col("g_column") == F.col("column_name")))
    return j.where(by_rule != F.col("unexpected_count")).select("batch_id", "column_name").distinct()


def _shifted(median: Column) -> Column:
    ratio = median / F.col("usual_median_value")
    return (F.col("usual_median_value") != 0) & ((ratio >= 2) | (ratio <= 0.5))


def recheck(metrics: DataFrame, df: DataFrame, load: str = "batch_id", checks=QUOTE_CHECKS) -> DataFrame:
    """The metrics with exact medians and distinct counts where the sketches' errors could decide a test: loads of more
    values than a sketch holds whose median's neighbourhood, or whose distinct count, lies about a limit."""
    m = profile_with_usual(metrics)
    n = F.col("rows") - F.col("null_rows")
    half = 0.5 * F.col("usual_distinct_values")
    unsure_median = (n > QUANTILE_K) & (_shifted(F.col("median_low")) != _shifted(F.col("median_high")))
    unsure_distinct = (F.col("distinct_values") > EXACT_DISTINCT) & (F.abs(F.col("distinct_values") - half) <= DISTINCT_MARGIN * half)
    unsure = F.coalesce(unsure_median, F.lit(False)) | F.coalesce(unsure_distinct, F.lit(False))
    need = written(m.where(unsure).select(F.col("batch_id").alias("x_batch"), F.col("column_name").alias("x_column")), "unsure")
    if need.isEmpty():
        return metrics
    numeric = {k.column for k in checks if k.numeric}
    cell = lambda c: F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("text"), (F.col(f"`{c}`") if c in numeric else F.lit(None)).cast("double").alias("x"))
    cells = df.select(F.col(f"`{load}`").alias("batch_id"), F.explode(F.array(*[cell(k.column) for k in checks])).alias("c")).select("batch_id", "c.*")
    key = F.col("batch_id").eqNullSafe(F.col("x_batch")) & (F.col("column_name") == F.col("x_column"))
    cells = written(cells.join(need, key, "left_semi"), "unsure-cells")
    distinct = cells.where(F.col("text").isNotNull()).select("batch_id", "column_name", "text").distinct().groupBy("batch_id", "column_name").agg(F.count("*").alias("x_distinct"))
    exact = need.join(distinct, key, "left").select("x_batch", "x_column", "x_distinct")
    medians = grouped_median(cells, ["batch_id", "column_name"], "x", "x_median").select(F.col("batch_id").alias("m_batch"), F.col("column_name").alias("m_column"), "x_median")
    exact = exact.join(medians, F.col("x_batch").eqNullSafe(F.col("m_batch")) & (F.col("x_column") == F.col("m_column")), "left").drop("m_batch", "m_column")
    out = metrics.join(exact, key, "left")
    return out.withColumn("distinct_values", F.coalesce("x_distinct", "distinct_values")).withColumn("median_value", F.coalesce("x_median", "median_value")).select(metrics.columns)


def find_issues(metrics: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """batch_id, column_name, issue: loads outside the control limits of their feed, and miscounts of the gate."""
    m = profile_with_usual(metrics.where(F.col("column_name").isin(*REPORTED)))
    tests = {
        "nulls": F.col("null_share") - F.col("usual_null_share") >= 0.15 - 1e-12,
        "pattern": F.col("unmatched_share") - F.col("usual_unmatched_share") >= 0.15 - 1e-12,
        "range": F.col("outside_share") >= 0.05,
        "shift": _shifted(F.col("median_value")),
        "distinct": F.col("distinct_values") < 0.5 * F.col("usual_distinct_values"),
    }
    issues = m.select("batch_id", "column_name", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))).alias("issue"))
    if gate is not None:
        issues = issues.unionByName(recorded_miscounts(metrics, gate).withColumn("issue", F.lit("miscount")))
    return issues
