"""Queries of the analytical operators over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge import schemas
from tickforge.functions.scalars import log_or_null
from tickforge.operators import answering, contract, expectations, lineage, medallion, metrics, retrieval, text, vectors
from tickforge.operators.tables import VersionedTable, WriteRefused, conform, merge_frames, violation_counts
from tickforge.sources import quotes
from tickforge.sources.fixtures import bars as _bars
from tickforge.streaming.ingest import drain_payloads
from tickforge.workspace import read, shared_path, written

QUESTION = "Which risks does the company see for server capacity, cloud workloads and credit spreads?"
OTHER_QUESTION = "reinsurance treaties and hail losses"
CUTOFF = dt.date(1997, 1, 1)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ORDER = "l_shipdate {d}, l_orderkey {d}, l_linenumber {d}, l_partkey {d}, l_suppkey {d}, l_extendedprice {d}, l_quantity {d}"
_BARS = f"""ticks AS (
  SELECT concat('T', chr(CAST(65 + n_nationkey AS INTEGER))) AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date,
         l_extendedprice / l_quantity AS px, l_quantity AS qty,
         row_number() OVER (PARTITION BY n_nationkey, date_trunc('week', l_shipdate) ORDER BY {_ORDER.format(d="")}) AS a,
         row_number() OVER (PARTITION BY n_nationkey, date_trunc('week', l_shipdate) ORDER BY {_ORDER.format(d="DESC")}) AS z
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
bars AS (
  SELECT ticker, trade_date, max(CASE WHEN a = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
         max(CASE WHEN z = 1 THEN px END) AS close, CAST(sum(qty) AS BIGINT) AS volume
  FROM ticks GROUP BY ticker, trade_date)"""


@_query(f"WITH {_BARS} SELECT * FROM bars")
def bars_fixture(spark: SparkSession, d: str) -> DataFrame:
    return _bars(spark, d)


# -- payloads, faults, contract ---------------------------------------------------------------------------------


@_query(
    f"WITH {_BARS} SELECT ticker, CAST(trade_date AS VARCHAR) AS trade_date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, true AS adj_is_null FROM bars"
)
def quote_payload_clean(spark, d):
    """Bars to JSON payloads and back; the null key survives."""
    p = contract.payloads(_bars(spark, d)).select(F.from_json("raw_payload", schemas.PAYLOAD).alias("p"), F.col("raw_payload").contains('"adj_close":null').alias("adj_is_null"))
    return p.select(*[f"p.{c}" for c in ("ticker", "trade_date", "open", "high", "low", "close", "volume")], "adj_is_null")


_FAULT_NAMES = ", ".join(f"'{f}'" for f in contract.FAULTS)
_DRAWN = f"""{_BARS},
hashed AS (SELECT *, md5(concat_ws('|', ticker, CAST(trade_date AS VARCHAR), '7')) AS h FROM bars),
drawn AS (SELECT *, CASE WHEN CAST('0x' || substr(h, 1, 8) AS BIGINT) / 4294967296.0 < 0.08
                         THEN ([{_FAULT_NAMES}])[CAST(CAST('0x' || substr(h, 9, 8) AS BIGINT) % 12 + 1 AS INTEGER)] END AS fault FROM hashed)"""
_EXPECTED = "CASE fault " + " ".join(f"WHEN '{f}' THEN '{r}'" for f, r in contract.FAULTS.items()) + " END"


def _faulty(spark, d):
    return contract.payloads(contract.draw_faults(_bars(spark, d)))


def _judged(spark, d):
    return contract.verdicts(_faulty(spark, d))


@_query(f"WITH {_DRAWN} SELECT fault, count(*) AS injected FROM drawn WHERE fault IS NOT NULL GROUP BY fault")
def fault_injection_counts(spark, d):
    return contract.draw_faults(_bars(spark, d)).where("fault IS NOT NULL").groupBy("fault").agg(F.count("*").alias("injected"))


@_query(f"WITH {_DRAWN} SELECT count(*) AS produced, count(fault) AS corrupted, count(*) - count(fault) AS clean FROM drawn")
def producer_tallies(spark, d):
    return contract.draw_faults(_bars(spark, d)).agg(F.count("*").alias("produced"), F.count("fault").alias("corrupted"), (F.count("*") - F.count("fault")).alias("clean"))


@_query(f"WITH {_DRAWN} SELECT ticker, trade_date, fault, {_EXPECTED} AS reason FROM drawn")
def contract_verdicts(spark, d):
    return _judged(spark, d).select("ticker", "trade_date", "fault", "reason")


@_query(f"WITH {_DRAWN} SELECT {_EXPECTED} AS reason, count(*) AS rejected FROM drawn WHERE fault IS NOT NULL GROUP BY 1")
def contract_reason_counts(spark, d):
    return contract.reason_counts(_judged(spark, d))


@_query(f"WITH {_DRAWN} SELECT ticker, count(*) AS admitted FROM drawn WHERE fault IS NULL GROUP BY ticker")
def contract_admitted(spark, d):
    return _judged(spark, d).where("reason IS NULL").groupBy("ticker").agg(F.count("*").alias("admitted"))


@_query(
    f"""WITH {_DRAWN} SELECT CASE fault WHEN 'negative_price' THEN 'close' WHEN 'zero_price' THEN 'open' WHEN 'missing_ticker' THEN 'ticker' WHEN 'blank_ticker' THEN 'ticker'
WHEN 'missing_close' THEN 'close' WHEN 'corrupt_timestamp' THEN 'trade_date' WHEN 'future_date' THEN 'trade_date' WHEN 'negative_volume' THEN 'volume'
WHEN 'non_numeric_price' THEN 'close' WHEN 'unexpected_field' THEN '<extra>' ELSE '<record>' END AS field, {_EXPECTED} AS reason, count(*) AS n
FROM drawn WHERE fault IS NOT NULL GROUP BY 1, 2"""
)
def contract_violations(spark, d):
    v = _judged(spark, d).select(F.explode("violations").alias("v"))
    return v.groupBy("v.field", "v.reason").agg(F.count("*").alias("n"))


@_query(f"WITH {_DRAWN} SELECT count(*) AS consumed, count(*) - count(fault) AS accepted, count(fault) AS rejected, round((count(*) - count(fault)) / count(*), 4) AS acceptance_rate FROM drawn")
def consumer_stats(spark, d):
    return contract.consumer_stats(_judged(spark, d))


@_query(
    f"WITH {_DRAWN} SELECT fault, count(*) AS injected, count(*) AS quarantined, CAST(0 AS BIGINT) AS escaped, CAST(1 AS DOUBLE) AS catch_rate, CAST(0 AS BIGINT) AS misclassified FROM drawn WHERE fault IS NOT NULL GROUP BY fault"
)
def contract_scorecard(spark, d):
    return contract.scorecard(_judged(spark, d))


@_query(f"WITH {_DRAWN} SELECT {_EXPECTED} AS reason, count(*) AS rejected FROM drawn WHERE fault IS NOT NULL AND fault LIKE 'negative%' GROUP BY 1")
def contract_organic(spark, d):
    """Rejections without a tag: here the tags of two faults are taken off."""
    tagged = F.when(~F.col("fault").startswith("negative"), F.col("fault"))
    return contract.organic_rejections(_judged(spark, d).withColumn("fault", tagged))


@_query(f"WITH {_DRAWN} SELECT count(fault) AS injected, count(fault) AS quarantined, CAST(0 AS BIGINT) AS escaped, CAST(0 AS BIGINT) AS misclassified, CAST(1 AS DOUBLE) AS catch_rate FROM drawn")
def contract_misclassified(spark, d):
    return contract.scorecard_total(contract.scorecard(_judged(spark, d)))


@_query("SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props)) AS valid, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY event_type")
def event_props_contract(spark, d):
    e = read(spark, d, "events").withColumn("v", F.try_parse_json("props"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNotNull()).alias("valid"), F.sum(F.try_variant_get("v", "$.k", "bigint")).alias("sum_k"))


# -- layers -----------------------------------------------------------------------------------------------------



def _bronze(spark, d, second: bool = True):
    """Raw records of the clean bars, and with ``second`` a later, changed message for every third day of the month."""
    b = _bars(spark, d)
    first = contract.payloads(b).select(F.col("raw_payload").alias("value"), F.lit("a.jsonl").alias("source_file"))
    lines = first.unionByName(spark.createDataFrame([("  ", "a.jsonl"), ("", "a.jsonl"), ("{broken", "a.jsonl")], "value STRING, source_file STRING"))
    if second:
        later = b.where(F.dayofmonth("trade_date") % 3 == 0).withColumn("close", F.col("low"))
        fixed = contract.payloads(later).select(F.regexp_replace("raw_payload", "T21:00:00", "T22:00:00").alias("value"), F.lit("b.jsonl").alias("source_file"))
        lines = lines.unionByName(fixed)
    return medallion.bronze_lines(lines, "batch-1", F.to_timestamp(F.lit("2025-01-01 00:00:00")))


_LINES = f"{_BARS}, msgs AS (SELECT *, 1 AS v FROM bars UNION ALL SELECT ticker, trade_date, open, high, low, low AS close, volume, 2 AS v FROM bars WHERE day(trade_date) % 3 = 0)"


@_query(f"WITH {_LINES} SELECT CASE v WHEN 1 THEN 'a.jsonl' ELSE 'b.jsonl' END AS source_file, count(*) + CASE v WHEN 1 THEN 1 ELSE 0 END AS lines, 'batch-1' AS batch_id FROM msgs GROUP BY v")
def bronze_lines(spark, d):
    return _bronze(spark, d).groupBy("source_file").agg(F.count("*").alias("lines"), F.min("batch_id").alias("batch_id"))


@_query(f"WITH {_LINES} SELECT ticker, trade_date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM msgs")
def silver_parse(spark, d):
    return medallion.silver_parse(_bronze(spark, d)).where(~medallion.unparseable()).select("ticker", "trade_date", "open", "high", "low", "close", "volume")


@_query(f"WITH {_LINES} SELECT count(*) + 1 AS parsed, CAST(1 AS BIGINT) AS unparseable FROM msgs")
def silver_unparseable(spark, d):
    return medallion.silver_parse(_bronze(spark, d)).agg(F.count("*").alias("parsed"), F.count_if(medallion.unparseable()).alias("unparseable"))


@_query(f"WITH {_BARS} SELECT ticker, trade_date, open, high, low, close, volume FROM bars")
def quotes_wide(spark, d):
    """Bars written as a wide file with other spellings of the columns, found, and loaded again."""
    at = shared_path(spark, "raw")
    b = _bars(spark, d)
    names = {"trade_date": "Date", "ticker": "Symbol", "open": "Open", "high": "HIGH", "low": " low", "close": "Close/Last", "volume": "Volume"}
    b.select(*[F.col(c).cast("string").alias(n) for c, n in names.items()]).coalesce(1).write.option("header", True).csv(f"{at}/wide")
    return quotes.load_quotes(spark, at).select("ticker", "trade_date", "open", "high", "low", "close", "volume")


@_query(f"WITH {_BARS} SELECT ticker, trade_date, round(CASE WHEN day(trade_date) % 3 = 0 THEN low ELSE close END, 6) AS close, volume FROM bars")
def silver_dedupe(spark, d):
    p = medallion.silver_parse(_bronze(spark, d)).where(~medallion.unparseable())
    return medallion.silver_dedupe(p).select("ticker", "trade_date", "close", "volume")


def _merged(spark, d):
    b = _bars(spark, d)
    target = b.where(F.col("trade_date") <= F.lit(CUTOFF))
    source = b.where(F.col("trade_date") > F.date_sub(F.lit(CUTOFF), 140)).withColumn("close", F.col("close") + 1)
    return merge_frames(target, source, ["ticker", "trade_date"])


_MERGED = f"""{_BARS}, tgt AS (SELECT * FROM bars WHERE trade_date <= DATE '{CUTOFF}'),
src AS (SELECT ticker, trade_date, open, high, low, close + 1 AS close, volume FROM bars WHERE trade_date > DATE '{CUTOFF}' - 140),
merged AS (SELECT coalesce(s.ticker, t.ticker) AS ticker, coalesce(s.trade_date, t.trade_date) AS trade_date, coalesce(s.close, t.close) AS close, coalesce(s.volume, t.volume) AS volume,
                  CASE WHEN t.ticker IS NULL THEN 'insert' WHEN s.ticker IS NULL THEN 'keep' ELSE 'update' END AS act
           FROM tgt t FULL JOIN src s ON t.ticker = s.ticker AND t.trade_date = s.trade_date)"""


@_query(f"WITH {_MERGED} SELECT ticker, trade_date, close, volume FROM merged")
def silver_merge(spark, d):
    return _merged(spark, d).select("ticker", "trade_date", "close", "volume")


@_query(
    f"WITH {_MERGED} SELECT count(*) FILTER (act = 'insert') AS inserted, count(*) FILTER (act = 'update') AS updated, count(*) FILTER (act = 'keep') AS kept, count(*) FILTER (act <> 'insert') AS rows_before, count(*) AS rows_after FROM merged"
)
def silver_merge_metrics(spark, d):
    return medallion.merge_metrics(_merged(spark, d))


@_query(f"WITH {_MERGED} SELECT count(*) FILTER (act = 'insert') AS inserted, count(*) FILTER (act = 'update') AS updated, count(*) FILTER (act = 'keep') AS kept, (SELECT count(DISTINCT ticker) FROM src) AS partitions, count(*) AS rows_after FROM merged")
def silver_table_merge(spark, d):
    """The same upsert, written: into a table partitioned by ticker, whose rows and metrics are read back."""
    b = _bars(spark, d)
    table = VersionedTable(spark, shared_path(spark, "silver")).create(b.schema, partition_by="ticker")
    table.append(b.where(F.col("trade_date") <= F.lit(CUTOFF)))
    m = table.merge(written(b.where(F.col("trade_date") > F.date_sub(F.lit(CUTOFF), 140)).withColumn("close", F.col("close") + 1), "source"), ["ticker", "trade_date"])
    done = table.manifest()["metrics"]
    return table.read().agg(F.lit(m["numInserted"]).cast("bigint").alias("inserted"), F.lit(m["numUpdated"]).cast("bigint").alias("updated"), F.lit(m["numKept"]).cast("bigint").alias("kept"), F.lit(done["partitionsReplaced"]).cast("bigint").alias("partitions"), F.count("*").alias("rows_after"))


@_query(
    f"""WITH {_BARS}, src AS (SELECT ticker, trade_date, CAST(trade_date AS VARCHAR) AS d, close FROM bars)
SELECT ticker, CAST(d AS DATE) AS trade_date, close, CAST(NULL AS DOUBLE) AS adj_close FROM src"""
)
def conform_projection(spark, d):
    wide = _bars(spark, d).withColumn("trade_date", F.col("trade_date").cast("string")).withColumn("adj_close", F.lit(None)).withColumn("surplus", F.lit(1))
    want = schemas.SILVER
    return conform(wide, type(want)([f for f in want if f.name in ("ticker", "trade_date", "close", "adj_close")]))


@_query(
    f"""WITH {_BARS}, bad AS (SELECT 'close_null' AS attempt, 'refused' AS outcome UNION ALL SELECT 'high_below_low', 'refused' UNION ALL SELECT 'negative_prices', 'refused'
UNION ALL SELECT 'missing_column', 'refused' UNION ALL SELECT 'extra_column', 'refused' UNION ALL SELECT 'wrong_type', 'refused' UNION ALL SELECT 'control', 'accepted')
SELECT attempt, outcome, n AS rows_before, n + CASE attempt WHEN 'control' THEN 1 ELSE 0 END AS rows_after FROM bad, (SELECT count(*) AS n FROM bars)"""
)
def write_refusals(spark, d):
    """Six bad writes and a control against a real table with stored constraints."""
    cols = ["ticker", "trade_date", "open", "high", "low", "close", "volume"]
    want = type(schemas.SILVER)([f for f in schemas.SILVER if f.name in cols])
    good = _bars(spark, d).select(cols)
    table = VersionedTable(spark, shared_path(spark, "enforced")).create(want, constraints=schemas.SILVER_CHECKS)
    table.append(good)
    n = table.read().count()
    one = good.orderBy("ticker", F.col("trade_date").desc()).limit(1).withColumn("trade_date", F.date_add("trade_date", 1))
    null = F.lit(None).cast("double")
    attempts = {
        "extra_column": one.withColumn("surplus", F.lit(1)),
        "missing_column": one.drop("close"),
        "wrong_type": one.withColumn("volume", F.col("volume").cast("string")),
        "close_null": one.withColumn("close", null),
        "high_below_low": one.withColumn("high", F.col("low") / 2),
        "negative_prices": one.withColumn("low", -F.col("low")),
        "control": one,
    }
    rows = []
    for name, frame in attempts.items():
        try:
            table.append(frame)
            outcome = "accepted"
        except WriteRefused:
            outcome = "refused"
        rows.append((name, outcome, n, table.read().count()))
    return spark.createDataFrame(rows, "attempt STRING, outcome STRING, rows_before BIGINT, rows_after BIGINT")


_TAINTED_UNION = """tainted AS (
  SELECT * FROM bars UNION ALL SELECT ticker, trade_date, open, 1.0, 9999.0, close, volume FROM (SELECT * FROM bars ORDER BY trade_date DESC, ticker LIMIT 3)
  UNION ALL SELECT ticker, trade_date, open, high, low, NULL, volume FROM (SELECT * FROM bars ORDER BY trade_date, ticker LIMIT 1)
  UNION ALL SELECT * FROM (SELECT * FROM bars ORDER BY trade_date DESC, ticker LIMIT 1))"""


@_query(
    f"""WITH {_BARS}, {_TAINTED_UNION} SELECT count(*) FILTER (close IS NULL) AS null_close, count(*) FILTER (NOT coalesce(high >= low, false)) AS high_not_below_low,
count(*) FILTER (NOT coalesce(high >= greatest(open, close), false)) AS high_spans_open_close FROM tainted"""
)
def write_violation_counts(spark, d):
    """The aggregates behind a refusal, on tainted bars."""
    bad = expectations.taint(_bars(spark, d))
    tests = violation_counts(type(schemas.SILVER)([f for f in schemas.SILVER if f.name == "close"]), {k: schemas.SILVER_CHECKS[k] for k in ("high_not_below_low", "high_spans_open_close")})
    return bad.agg(*[c.alias(n.replace("NOT NULL ", "null_")) for n, c in tests.items()])


# -- window metrics ---------------------------------------------------------------------------------------------

_W = "OVER (PARTITION BY ticker ORDER BY trade_date"
_ENRICHED = f"""{_BARS},
r AS (SELECT *, lag(close) {_W}) AS prev_close FROM bars),
l AS (SELECT *, CASE WHEN prev_close > 0 THEN ln(close / prev_close) END AS log_return FROM r),
e AS (SELECT *, avg(close) {_W} ROWS 6 PRECEDING) AS ma_7, avg(close) {_W} ROWS 29 PRECEDING) AS ma_30, avg(volume) {_W} ROWS 29 PRECEDING) AS avg_volume_30d,
             stddev_samp(log_return) {_W} ROWS 29 PRECEDING) AS stddev_30d, max(high) {_W} ROWS 251 PRECEDING) AS high_52w, min(low) {_W} ROWS 251 PRECEDING) AS low_52w,
             count(*) OVER (PARTITION BY ticker) AS sessions_observed, min(trade_date) OVER (PARTITION BY ticker) AS first_session FROM l),
m AS (SELECT *, lag(ma_30) {_W}) AS ma_30_prev FROM e)"""
_TREND = "CASE WHEN ma_30 IS NULL OR ma_30_prev IS NULL THEN NULL WHEN ma_30 > ma_30_prev + 1e-9 THEN 'RISING' WHEN ma_30 < ma_30_prev - 1e-9 THEN 'FALLING' ELSE 'FLAT' END"


@_query(f"WITH {_ENRICHED} SELECT ticker, trade_date, round(prev_close, 6) AS prev_close, round(log_return, 6) AS log_return FROM m")
def gold_log_returns(spark, d):
    return metrics.log_returns(_bars(spark, d)).select("ticker", "trade_date", F.round("prev_close", 6).alias("prev_close"), F.round("log_return", 6).alias("log_return"))


@_query(f"WITH {_ENRICHED} SELECT ticker, trade_date, round(ma_7, 4) AS ma_7, round(ma_30, 4) AS ma_30, round(ma_30_prev, 4) AS ma_30_prev, round(avg_volume_30d, 2) AS avg_volume_30d FROM m")
def gold_moving_averages(spark, d):
    m = metrics.moving_averages(_bars(spark, d))
    return m.select("ticker", "trade_date", *[F.round(c, 4).alias(c) for c in ("ma_7", "ma_30", "ma_30_prev")], F.round("avg_volume_30d", 2).alias("avg_volume_30d"))


@_query(f"WITH {_ENRICHED} SELECT ticker, trade_date, round(stddev_30d * sqrt(252.0) * 100, 4) AS volatility FROM m")
def gold_volatility(spark, d):
    v = metrics.volatility(metrics.log_returns(_bars(spark, d)))
    return v.select("ticker", "trade_date", F.round(F.col("stddev_30d") * F.sqrt(F.lit(252.0)) * 100, 4).alias("volatility"))


@_query(f"WITH {_ENRICHED} SELECT ticker, trade_date, high_52w, low_52w, round(CASE WHEN high_52w > 0 THEN (close - high_52w) / high_52w * 100 END, 4) AS pct_from_52w_high FROM m")
def gold_range_52w(spark, d):
    r = metrics.yearly_range(_bars(spark, d))
    return r.select("ticker", "trade_date", "high_52w", "low_52w", F.round(metrics.pct_from(F.col("close"), F.col("high_52w")), 4).alias("pct_from_52w_high"))


@_query(f"WITH {_ENRICHED} SELECT ticker, trade_date, {_TREND} AS ma_30_trend FROM m")
def gold_trend(spark, d):
    m = metrics.moving_averages(_bars(spark, d))
    return m.select("ticker", "trade_date", metrics.trend(F.col("ma_30"), F.col("ma_30_prev")).alias("ma_30_trend"))


@_query(f"WITH {_ENRICHED} SELECT DISTINCT ticker, sessions_observed, first_session FROM m")
def gold_history_span(spark, d):
    return metrics.history_span(_bars(spark, d)).select("ticker", "sessions_observed", "first_session").distinct()


_SNAP = f"""SELECT ticker, trade_date AS as_of_date, round(close, 4) AS latest_close, round(ma_7, 4) AS ma_7, round(ma_30, 4) AS ma_30, round(ma_30_prev, 4) AS ma_30_prev, {_TREND} AS ma_30_trend,
round(CASE WHEN ma_30 > 0 THEN (close - ma_30) / ma_30 * 100 END, 4) AS pct_vs_ma_30, round(stddev_30d * sqrt(252.0) * 100, 4) AS volatility_30d_annualised, round(avg_volume_30d, 2) AS avg_volume_30d,
round(high_52w, 4) AS high_52w, round(low_52w, 4) AS low_52w, round(CASE WHEN high_52w > 0 THEN (close - high_52w) / high_52w * 100 END, 4) AS pct_from_52w_high, sessions_observed, first_session
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) AS pick FROM m) WHERE pick = 1"""


@_query(f"WITH {_ENRICHED} {_SNAP}")
def gold_ticker_metrics(spark, d):
    return metrics.ticker_metrics(_bars(spark, d))


@_query(f"WITH {_ENRICHED} SELECT ticker, latest_close, ma_30_trend FROM ({_SNAP}) ORDER BY ticker LIMIT 20")
def gold_read_top(spark, d):
    return metrics.ticker_metrics(_bars(spark, d)).select("ticker", "latest_close", "ma_30_trend").orderBy("ticker").limit(20)


def _gold_merge(spark, d, reverse: bool):
    """Snapshots as of two dates; every second ticker is missing in the target."""
    b = _bars(spark, d)
    snap = lambda x: x.groupBy("ticker").agg(F.max("trade_date").alias("as_of_date"), F.max_by("close", "trade_date").alias("latest_close"))
    old, new = snap(b.where(F.col("trade_date") <= F.lit(CUTOFF))), snap(b)
    target, source = (new, old) if reverse else (old, new)
    target = target.where(F.ascii(F.substring("ticker", 2, 1)) % 2 == 0)
    return merge_frames(target, source, ["ticker"], guard=medallion.gold_guard).select("ticker", "as_of_date", "latest_close", F.col("__action").alias("action"))


def _gold_merge_sql(reverse: bool) -> str:
    t, s = ("new", "old") if reverse else ("old", "new")
    return f"""WITH {_BARS}, old AS (SELECT ticker, max(trade_date) AS as_of_date, arg_max(close, trade_date) AS latest_close FROM bars WHERE trade_date <= DATE '{CUTOFF}' GROUP BY ticker),
new AS (SELECT ticker, max(trade_date) AS as_of_date, arg_max(close, trade_date) AS latest_close FROM bars GROUP BY ticker),
t AS (SELECT * FROM {t} WHERE ascii(substr(ticker, 2, 1)) % 2 = 0),
j AS (SELECT coalesce(s.ticker, t.ticker) AS ticker, t.as_of_date AS ta, t.latest_close AS tc, s.as_of_date AS sa, s.latest_close AS sc,
      CASE WHEN t.ticker IS NULL THEN 'insert' WHEN s.ticker IS NULL THEN 'keep' WHEN s.as_of_date >= t.as_of_date THEN 'update' ELSE 'keep' END AS action FROM t FULL JOIN {s} s ON t.ticker = s.ticker)
SELECT ticker, CASE WHEN action = 'keep' THEN ta ELSE sa END AS as_of_date, CASE WHEN action = 'keep' THEN tc ELSE sc END AS latest_close, action FROM j"""


@_query(_gold_merge_sql(True))
def gold_merge_guarded(spark, d):
    return _gold_merge(spark, d, True)


@_query(_gold_merge_sql(False))
def gold_merge_update(spark, d):
    return _gold_merge(spark, d, False)


# -- expectations -----------------------------------------------------------------------------------------------

_KNOWN = tuple(f"T{chr(65 + i)}" for i in range(24))


def _gate(spark, d, kinds: tuple[str, ...] | None = None, clean: bool = False):
    b = _bars(spark, d)
    suite = [e for e in expectations.quote_suite(_KNOWN) if kinds is None or e.kind in kinds]
    b = written(b, "bars")  # the bad rows and the uniqueness pass read it again
    return expectations.evaluate(b if clean else written(expectations.taint(b), "tainted"), suite)


def _suite_sql(kinds: tuple[str, ...] | None = None) -> str:
    conds = {
        "pair_at_least": "{a} < {b}", "not_null": "{column} IS NULL", "above": "{column} <= {low}", "at_least": "{column} < {low}",
        "in_set": "ticker NOT IN (" + ", ".join(f"'{t}'" for t in _KNOWN) + ")",
    }
    parts = []
    for e in expectations.quote_suite(_KNOWN):
        if kinds and e.kind not in kinds:
            continue
        if e.kind in conds:
            n = f"count(*) FILTER ({conds[e.kind].format(**e.args)})"
        elif e.kind == "compound_unique":
            n = "CAST((SELECT coalesce(sum(c), 0) FROM (SELECT count(*) AS c FROM x GROUP BY ticker, trade_date) WHERE c > 1) AS BIGINT)"
        else:
            n = "CAST(CASE WHEN count(*) >= 1 THEN 0 ELSE 1 END AS BIGINT)"
        parts.append(f"SELECT '{e.label}' AS label, '{e.kind}' AS kind, count(*) AS element_count, {n} AS unexpected_count FROM x")
    return "(" + " UNION ALL ".join(parts) + ")"


def _gate_sql(kinds=None, clean=False) -> str:
    return f"WITH {_BARS}, {_TAINTED_UNION}, x AS (SELECT * FROM {'bars' if clean else 'tainted'}) SELECT *, CAST(unexpected_count AS DOUBLE) / element_count * 100 AS unexpected_percent, unexpected_count = 0 AS success FROM {_suite_sql(kinds)}"


for _name, _kinds in {
    "gate_pairs": ("pair_at_least",), "gate_not_null": ("not_null",), "gate_ranges": ("above", "at_least"), "gate_compound_unique": ("compound_unique",),
    "gate_row_count": ("row_count",), "gate_in_set": ("in_set",),
}.items():
    QUERIES[_name] = lambda spark, d, k=_kinds: _gate(spark, d, k)
    SQL[_name] = _gate_sql(_kinds)


def _summary_sql(clean: bool) -> str:
    return f"SELECT count(*) AS evaluated, count(*) FILTER (success) AS successful, bool_and(success) AS success, max(element_count) AS rows FROM ({_gate_sql(None, clean)})"


@_query(_summary_sql(True))
def gate_summary_clean(spark, d):
    return expectations.summarise(_gate(spark, d, clean=True))


@_query(_summary_sql(False))
def gate_summary_tainted(spark, d):
    return expectations.summarise(_gate(spark, d))


# -- texts ------------------------------------------------------------------------------------------------------


def _docs(spark, d):
    return read(spark, d, "documents")


# white space as Python has it, for RE2
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LABEL = """concat(coalesce(nullif(trim(ticker), ''), nullif(trim(company), ''), ''), ' ', coalesce(form_type, ''), ' ', coalesce(nullif(trim(CAST(fiscal_year AS VARCHAR)), ''), 'n.d.'), ' · ',
coalesce(item, ''), ' ', coalesce(section_title, ''))"""


def _strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{_SPACE}]+', ''), '[{_SPACE}]+$', '')"


_CHUNKS = f"""RECURSIVE walk(doc_id, chunk_index, begin, stop) AS (
  SELECT doc_id, -1, 0, {text.CHUNK_OVERLAP} FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, chunk_index + 1, pos, CASE WHEN pos + {text.CHUNK_CHARS} >= n THEN n WHEN blank > 0 THEN low + length(tail) - blank + 1 WHEN said > 0 THEN low + said ELSE pos + {text.CHUNK_CHARS} END
  FROM (SELECT *, strpos(reverse(tail), chr(10) || chr(10)) AS blank, length(regexp_extract(tail, '(?s)^(.*[.!?][{_SPACE}]+)', 1)) AS said
    FROM (SELECT w.doc_id, chunk_index, pos, pos + {int(text.CHUNK_CHARS * 0.6)} AS low, length(d.text) AS n, substr(d.text, pos + {int(text.CHUNK_CHARS * 0.6)} + 1, {text.CHUNK_CHARS - int(text.CHUNK_CHARS * 0.6)}) AS tail
      FROM (SELECT *, CASE WHEN chunk_index < 0 THEN 0 ELSE greatest(stop - {text.CHUNK_OVERLAP}, begin + 1) END AS pos FROM walk) w JOIN documents d ON d.doc_id = w.doc_id WHERE chunk_index < 0 OR stop < length(d.text)))),
spans AS (SELECT w.doc_id, chunk_index, begin AS char_start, stop AS char_end, {_strip_sql("substr(d.text, begin + 1, stop - begin)")} AS body,
  d.* EXCLUDE (doc_id, text) FROM walk w JOIN documents d ON d.doc_id = w.doc_id WHERE chunk_index >= 0),
chunks AS (SELECT *, substr(sha1(concat(coalesce(source_file, ''), '|', coalesce(item, ''), '|', chunk_index, '|', substr(body, 1, 200))), 1, 16) AS chunk_id FROM spans WHERE length(body) >= {text.MIN_CHUNK})"""


@_query(f"WITH {_CHUNKS} SELECT doc_id, chunk_index, char_start, char_end FROM spans")
def chunk_spans(spark, d):
    return text.chunk_spans(_docs(spark, d)).select("doc_id", "chunk_index", "char_start", "char_end")


@_query(f"WITH {_CHUNKS} SELECT chunk_id, doc_id, chunk_index, {_LABEL} AS citation_label FROM chunks")
def chunk_ids(spark, d):
    c = text.chunks(_docs(spark, d))
    return c.select("chunk_id", "doc_id", "chunk_index", text.citation_label(*[F.col(x) for x in ("ticker", "company", "form_type", "fiscal_year", "item", "section_title")]).alias("citation_label"))


@_query(f"WITH {_CHUNKS} SELECT item, count(*) AS chunks, count(DISTINCT source_file) AS files, round(avg(length(body)), 2) AS mean_chars FROM chunks GROUP BY item")
def chunk_stats(spark, d):
    c = text.chunks(_docs(spark, d))
    return c.groupBy("item").agg(F.count("*").alias("chunks"), F.countDistinct("source_file").alias("files"), F.round(F.avg(F.length("body")), 2).alias("mean_chars"))


@_query(
    """SELECT doc_id, concat(coalesce(nullif(trim(ticker), ''), nullif(trim(company), ''), ''), ' ', coalesce(form_type, ''), ' ', coalesce(nullif(trim(CAST(fiscal_year AS VARCHAR)), ''), 'n.d.'), ' · ',
coalesce(item, ''), ' ', coalesce(section_title, '')) AS citation_label FROM documents"""
)
def citation_labels(spark, d):
    return _docs(spark, d).select("doc_id", text.citation_label(*[F.col(x) for x in ("ticker", "company", "form_type", "fiscal_year", "item", "section_title")]).alias("citation_label"))


_PAGE_TEXT = """regexp_replace(translate(text, chr(160) || '’“”', ' ''""'), '[ \t]+', ' ', 'g')"""


@_query(rf"SELECT doc_id, CASE WHEN text IS NOT NULL THEN {_strip_sql(rf"regexp_replace({_PAGE_TEXT}, '\n[{_SPACE}]*\n[{_SPACE}]*\n+', chr(10) || chr(10), 'g')")} END AS plain FROM documents")
def page_text(spark, d):
    """Texts wrapped in markup, and back to prose."""
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><style>p {}</style></head><body><p>"), safe, F.lit("</p><script>x()</script></body></html>"))
    return text.strip_markup(_docs(spark, d).select("doc_id", page.alias("html")), "html").select("doc_id", "plain")


def _sections_sql() -> str:
    pattern = lambda p: p.replace(r"\s", f"[{_SPACE}]").replace("'", "''")
    marks = " UNION ALL ".join(
        f"SELECT doc_id, '{item}' AS item, '{title.replace(chr(39), chr(39) * 2)}' AS title, {str(wanted).lower()} AS wanted, length(regexp_extract(text, '(?is)^(.*){pattern(p)}', 1)) AS begin, text FROM documents WHERE regexp_matches(text, '(?is){pattern(p)}')"
        for item, title, p, wanted in text.HEADINGS
    )
    cut = _strip_sql("substr(text, begin + 1, coalesce(lead(begin) OVER (PARTITION BY doc_id ORDER BY begin), length(text)) - begin)")
    return f"WITH marks AS ({marks}), bodies AS (SELECT doc_id, item, title, wanted, {cut} AS body FROM marks) SELECT doc_id, item, title, body FROM bodies WHERE wanted AND length(body) >= {text.MIN_SECTION}"


@_query(_sections_sql())
def section_slices(spark, d):
    return text.split_sections(_docs(spark, d).select("doc_id", "text"))


@_query(
    """WITH f AS (SELECT company, bool_or(contains(upper(company), 'LABS')) AS preferred, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS sections FROM documents WHERE company IS NOT NULL AND text IS NOT NULL GROUP BY company)
SELECT company, preferred, chars, sections FROM f ORDER BY preferred DESC, chars DESC, company LIMIT 25"""
)
def filing_priority(spark, d):
    """Preferred companies first, then those with most text."""
    wanted = F.array(F.lit("LABS"))
    docs = _docs(spark, d).where(F.col("company").isNotNull() & F.col("text").isNotNull())
    f = docs.groupBy("company").agg(F.max(F.exists(wanted, lambda w: F.contains(F.upper("company"), w))).alias("preferred"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("sections"))
    return f.orderBy(F.col("preferred").desc(), F.col("chars").desc(), "company").limit(25)


_TOKENS = """toks AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents WHERE text IS NOT NULL)"""
_POSTS = f"""{_TOKENS}, posts AS (SELECT id, term, length, count(*) AS tf FROM (SELECT id, len(ts) AS length, unnest(ts) AS term FROM toks) GROUP BY ALL)"""


@_query(f"WITH {_POSTS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM posts GROUP BY term")
def tokens_df(spark, d):
    return retrieval.document_frequencies(retrieval.postings(_docs(spark, d)))


def _bm25_sql(question: str) -> str:
    words = retrieval._tokenise(question)
    q = " UNION ALL ".join(f"SELECT '{w}' AS term, {words.count(w)} AS qtf" for w in sorted(set(words)))
    return f"""{_POSTS}, size AS (SELECT count(*) AS N, (SELECT CAST(sum(len(ts)) AS DOUBLE) FROM toks) / count(*) AS avgdl FROM documents),
dfs AS (SELECT term, ln(N - df + 0.5) - ln(df + 0.5) AS idf, avgdl FROM (SELECT term, count(*) AS df FROM posts GROUP BY term), size),
w AS (SELECT term, avgdl, qtf * CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM dfs) ELSE idf END AS w FROM dfs JOIN ({q}) USING (term)),
sparse AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
  SELECT id, round(sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) AS score FROM posts JOIN w USING (term) GROUP BY id) WHERE score > 0 ORDER BY score DESC, id LIMIT 30)"""


@_query(f"WITH {_bm25_sql(QUESTION)} SELECT * FROM sparse")
def bm25_top30(spark, d):
    return retrieval.sparse_search(_docs(spark, d), QUESTION)


_DENSE = """qv AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
dense AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
  SELECT vec_id AS id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(qv.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))
         / sqrt(list_dot_product(CAST(qv.embedding AS DOUBLE[]), CAST(qv.embedding AS DOUBLE[]))), 6) AS score FROM embeddings e, qv) ORDER BY score DESC, id LIMIT 30)"""


def _dense(spark, d):
    v = read(spark, d, "embeddings")
    query = v.where("vec_id = 0").select("embedding").first()[0]
    return retrieval.dense_search(v, list(query))


@_query(f"WITH {_DENSE} SELECT * FROM dense")
def dense_top30(spark, d):
    return _dense(spark, d)


def _fused_sql(k: int) -> str:
    return f"""{_bm25_sql(QUESTION)}, {_DENSE},
lists AS (SELECT id, rank, score, 0 AS list, 'dense' AS name FROM dense UNION ALL SELECT id, rank, score, 1, 'sparse' FROM sparse),
fused AS (SELECT id, rrf_score, dense_rank, dense_score, sparse_rank, sparse_score, retrievers, row_number() OVER (ORDER BY rrf_score DESC, l, p) AS final_rank FROM (
  SELECT id, round(sum(1.0 / ({k} + rank)), 10) AS rrf_score, min({{'l': list, 'p': rank}}).l AS l, min({{'l': list, 'p': rank}}).p AS p,
         max(CASE WHEN list = 0 THEN rank END) AS dense_rank, max(CASE WHEN list = 0 THEN score END) AS dense_score,
         max(CASE WHEN list = 1 THEN rank END) AS sparse_rank, max(CASE WHEN list = 1 THEN score END) AS sparse_score, string_agg(name, ',' ORDER BY list) AS retrievers FROM lists GROUP BY id))"""


def _fuse(spark, d, k):
    return retrieval.fuse({"dense": _dense(spark, d), "sparse": retrieval.sparse_search(_docs(spark, d), QUESTION)}, k)


_FUSED_COLUMNS = "id, CAST(rrf_score AS DOUBLE) AS rrf_score, dense_rank, dense_score, sparse_rank, sparse_score, retrievers, final_rank"


@_query(f"WITH {_fused_sql(60)} SELECT {_FUSED_COLUMNS} FROM fused")
def rrf_fused(spark, d):
    return _fuse(spark, d, 60).withColumn("retrievers", F.array_join("retrievers", ","))


@_query(f"WITH {_fused_sql(1)} SELECT {_FUSED_COLUMNS} FROM fused")
def rrf_small_k(spark, d):
    return _fuse(spark, d, 1).withColumn("retrievers", F.array_join("retrievers", ","))


_ASKED = sorted(set(retrieval._tokenise(QUESTION)))
_RERANK = f"""{_fused_sql(60)}, scored AS (
  SELECT f.id, f.final_rank AS before, coalesce(round(len(list_intersect([{", ".join(f"'{w}'" for w in _ASKED)}], regexp_extract_all(lower(text), '[a-z0-9]+'))) / {float(len(_ASKED))}, 6), 0.0) AS rerank_score
  FROM fused f JOIN documents d ON d.doc_id = f.id),
reranked AS (SELECT *, row_number() OVER (ORDER BY rerank_score DESC, before) AS final_rank FROM (SELECT * FROM scored ORDER BY rerank_score DESC, before LIMIT 6))"""


def _reranked(spark, d):
    fused = written(_fuse(spark, d, 60), "fused")
    texts = _docs(spark, d).select(F.col("doc_id").alias("id"), "text")
    return fused, retrieval.rerank(fused, texts, retrieval.lexical_overlap(QUESTION))


@_query(f"WITH {_RERANK} SELECT id, before, CAST(rerank_score AS DOUBLE) AS rerank_score, final_rank FROM reranked")
def rerank_lexical(spark, d):
    return _reranked(spark, d)[1]


@_query(f"WITH {_RERANK}, b AS (SELECT id FROM fused WHERE final_rank <= 6) SELECT id, 'promoted' AS move FROM reranked WHERE id NOT IN (FROM b) UNION ALL SELECT id, 'demoted' FROM b WHERE id NOT IN (SELECT id FROM reranked)")
def rerank_moves(spark, d):
    return retrieval.moves(*_reranked(spark, d))


@_query(f"WITH {_fused_sql(60)} SELECT id FROM (SELECT id FROM dense WHERE rank <= 30 INTERSECT SELECT id FROM fused WHERE final_rank <= 30)")
def top_list_overlap(spark, d):
    dense = _dense(spark, d).select("id")
    return dense.intersect(_fuse(spark, d, 60).where("final_rank <= 30").select("id"))


# Sets of queries: every row whose id is divisible by 50 asks, against all rows. An id asks with its vector, with its text, or with both.

_EVERY = 50
_DENSE_SET = f"""qv AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % {_EVERY} = 0),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, vec_id AS id, round(list_dot_product(v, q) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(q, q)), 6) AS score
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), qv)) WHERE rank <= 30)"""
_SPARSE_SET = f"""{_POSTS}, size AS (SELECT count(*) AS N, (SELECT CAST(sum(len(ts)) AS DOUBLE) FROM toks) / count(*) AS avgdl FROM documents),
dfs AS (SELECT term, ln(N - df + 0.5) - ln(df + 0.5) AS idf, avgdl FROM (SELECT term, count(*) AS df FROM posts GROUP BY term), size),
w AS (SELECT q.id AS query_id, term, avgdl, q.tf * CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM dfs) ELSE idf END AS w FROM dfs JOIN posts q USING (term) WHERE q.id % {_EVERY} = 0),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) AS score FROM posts JOIN w USING (term) GROUP BY query_id, id) WHERE score > 0) WHERE rank <= 30)"""


def _questions(spark, d):
    return _docs(spark, d).where(F.col("doc_id") % _EVERY == 0).select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))


@_query(f"WITH {_SPARSE_SET} SELECT * FROM sparse")
def bm25_set_top30(spark, d):
    return retrieval.sparse_search_set(_docs(spark, d), _questions(spark, d))


@_query(f"WITH {_DENSE_SET} SELECT * FROM dense")
def dense_set_top30(spark, d):
    v = read(spark, d, "embeddings")
    return retrieval.dense_search_set(v, v.where(F.col("vec_id") % _EVERY == 0).withColumnRenamed("vec_id", "query_id"))


def _vector_index(spark, d):
    v = read(spark, d, "embeddings")
    asked = v.where(F.col("vec_id") % _EVERY == 0).withColumnRenamed("vec_id", "query_id")
    return vectors.VectorIndex(v).calibrated(asked), asked


@_query()
def dense_index_top30(spark, d):
    """The set of queries through inverted lists."""
    index, asked = _vector_index(spark, d)
    return index.search(asked)


@_query()
def dense_index_recall(spark, d):
    """How much of the whole search the index finds."""
    index, asked = _vector_index(spark, d)
    return spark.createDataFrame([(asked.count(), index.lists, index.probes, index.recall(asked))], "queries BIGINT, lists INT, probes INT, recall DOUBLE")


def _fused_set_sql(k: int) -> str:
    return f"""{_SPARSE_SET}, {_DENSE_SET},
lists AS (SELECT query_id, id, rank, score, 0 AS list, 'dense' AS name FROM dense UNION ALL SELECT query_id, id, rank, score, 1, 'sparse' FROM sparse),
fused AS (SELECT query_id, id, rrf_score, dense_rank, dense_score, sparse_rank, sparse_score, retrievers, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, l, p) AS final_rank FROM (
  SELECT query_id, id, round(sum(1.0 / ({k} + rank)), 10) AS rrf_score, min({{'l': list, 'p': rank}}).l AS l, min({{'l': list, 'p': rank}}).p AS p,
         max(CASE WHEN list = 0 THEN rank END) AS dense_rank, max(CASE WHEN list = 0 THEN score END) AS dense_score,
         max(CASE WHEN list = 1 THEN rank END) AS sparse_rank, max(CASE WHEN list = 1 THEN score END) AS sparse_score, string_agg(name, ',' ORDER BY list) AS retrievers FROM lists GROUP BY query_id, id))"""


def _fuse_set(spark, d, k):
    return retrieval.fuse({"dense": dense_set_top30(spark, d), "sparse": bm25_set_top30(spark, d)}, k, ("query_id",))


@_query(f"WITH {_fused_set_sql(60)} SELECT query_id, {_FUSED_COLUMNS} FROM fused")
def rrf_set_fused(spark, d):
    return _fuse_set(spark, d, 60).withColumn("retrievers", F.array_join("retrievers", ","))


@_query(f"WITH {_fused_set_sql(1)} SELECT query_id, {_FUSED_COLUMNS} FROM fused")
def rrf_set_small_k(spark, d):
    return _fuse_set(spark, d, 1).withColumn("retrievers", F.array_join("retrievers", ","))


_RERANK_SET = f"""{_fused_set_sql(60)}, asked AS (SELECT id AS query_id, list_distinct(ts) AS words FROM toks WHERE id % {_EVERY} = 0),
scored AS (SELECT f.query_id, f.id, f.final_rank AS before, coalesce(round(len(list_intersect(words, regexp_extract_all(lower(text), '[a-z0-9]+'))) / greatest(1.0, CAST(len(words) AS DOUBLE)), 6), 0.0) AS rerank_score
  FROM fused f JOIN documents d ON d.doc_id = f.id LEFT JOIN asked a ON a.query_id = f.query_id),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, before) AS final_rank FROM scored) WHERE final_rank <= 6)"""


def _reranked_set(spark, d):
    fused = written(_fuse_set(spark, d, 60), "fused")
    return fused, retrieval.rerank_set(fused, _docs(spark, d).select(F.col("doc_id").alias("id"), "text"), _questions(spark, d))


@_query(f"WITH {_RERANK_SET} SELECT query_id, id, before, CAST(rerank_score AS DOUBLE) AS rerank_score, final_rank FROM reranked")
def rerank_set_lexical(spark, d):
    return _reranked_set(spark, d)[1]


@_query(
    f"""WITH {_RERANK_SET}, b AS (SELECT query_id, id FROM fused WHERE final_rank <= 6), a AS (SELECT query_id, id FROM reranked)
SELECT query_id, id, 'promoted' AS move FROM (FROM a EXCEPT FROM b) UNION ALL SELECT query_id, id, 'demoted' FROM (FROM b EXCEPT FROM a)"""
)
def rerank_set_moves(spark, d):
    return retrieval.moves(*_reranked_set(spark, d), by=("query_id",))


@_query(f"WITH {_fused_set_sql(60)} SELECT query_id, id FROM dense WHERE rank <= 30 INTERSECT SELECT query_id, id FROM fused WHERE final_rank <= 30")
def top_list_set_overlap(spark, d):
    return dense_set_top30(spark, d).select("query_id", "id").intersect(_fuse_set(spark, d, 60).where("final_rank <= 30").select("query_id", "id"))


# The chain over stored chunks: every document whose id is divisible by 50 asks with its first sentence's words.


def _chunk_index(spark, d, docs=None):
    index = answering.ChunkIndex(spark, shared_path(spark, "index"))
    return index, index.build(_docs(spark, d) if docs is None else docs)


@_query(
    f"""WITH {_CHUNKS}, b AS (SELECT DISTINCT chunk_id FROM chunks), a AS (SELECT DISTINCT chunk_id FROM chunks WHERE source IS DISTINCT FROM 'press_wire')
SELECT 1 AS build, (SELECT count(*) FROM a) AS embedded, 0 AS reused, 0 AS removed UNION ALL SELECT 2, 0, (SELECT count(*) FROM a), 0
UNION ALL SELECT 3, (SELECT count(*) FROM b WHERE chunk_id NOT IN (FROM a)), (SELECT count(*) FROM a), 0 UNION ALL SELECT 4, 0, (SELECT count(*) FROM a), (SELECT count(*) FROM b WHERE chunk_id NOT IN (FROM a))"""
)
def index_build(spark, d):
    """Four builds: without one source, the same again, with it, and without it again."""
    docs = _docs(spark, d)
    some = docs.where(~F.col("source").eqNullSafe("press_wire"))
    index, first = _chunk_index(spark, d, some)
    rows = [first, index.build(some), index.build(docs), index.build(some)]
    return spark.createDataFrame([(i + 1, r["embedded"], r["reused"], r["removed"]) for i, r in enumerate(rows)], "build INT, embedded BIGINT, reused BIGINT, removed BIGINT")


_CHUNK_SPARSE = f"""{_CHUNKS}, c AS (SELECT chunk_id, min(body) AS body FROM chunks GROUP BY chunk_id), toks AS (SELECT chunk_id AS id, regexp_extract_all(lower(body), '[a-z0-9]+') AS ts FROM c),
posts AS (SELECT id, term, length, count(*) AS tf FROM (SELECT id, len(ts) AS length, unnest(ts) AS term FROM toks) GROUP BY ALL),
asked AS (SELECT doc_id AS query_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents WHERE doc_id % 50 = 0) GROUP BY ALL),
size AS (SELECT (SELECT count(*) FROM c) AS N, (SELECT CAST(sum(len(ts)) AS DOUBLE) FROM toks) / (SELECT count(*) FROM c) AS avgdl),
dfs AS (SELECT term, ln(N - df + 0.5) - ln(df + 0.5) AS idf, avgdl FROM (SELECT term, count(*) AS df FROM posts GROUP BY term), size),
w AS (SELECT query_id, term, avgdl, tf * CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM dfs) ELSE idf END AS w FROM dfs JOIN asked USING (term))"""


@_query(
    f"""WITH {_CHUNK_SPARSE} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) AS score FROM posts JOIN w USING (term) GROUP BY query_id, id) WHERE score > 0) WHERE rank <= 30"""
)
def index_sparse_top30(spark, d):
    """BM25 over stored chunks from the postings of the asked terms."""
    return _chunk_index(spark, d)[0].sparse(_questions(spark, d))


@_query()
def hybrid_top6(spark, d):
    """Fused and reranked passages of stored chunks."""
    index, _ = _chunk_index(spark, d)
    asked = _questions(spark, d)
    return answering.rerank_passages(index, written(answering.hybrid_search(index, asked), "fused"), asked).drop("text")


@_query()
def answer_audit(spark, d):
    """The whole chain: one audit row per question, with what its answer cites."""
    answers, audit = answering.answer_questions(_chunk_index(spark, d)[0], _questions(spark, d))
    return audit.join(answers.select("query_id", "refused", "sources_supplied", F.size("warnings").alias("warnings")), "query_id")


_MARKERS = r"""m AS (SELECT answer_id AS id, sources_supplied AS supplied, regexp_replace(n, '^0+(\d)', '\1') AS n, pos FROM (
  SELECT answer_id, sources_supplied, unnest(ns) AS n, generate_subscripts(ns, 1) - 1 AS pos FROM (SELECT *, regexp_extract_all(answer, '\[S(\d+)\]', 1) AS ns FROM grounded_answers))),
c AS (SELECT *, TRY_CAST(n AS BIGINT) AS source_index FROM (SELECT id, supplied, n, min(pos) AS first_pos FROM m GROUP BY ALL))"""


@_query(f"WITH {_MARKERS} SELECT id, concat('[S', n, ']') AS marker, source_index, CAST(first_pos AS INTEGER) AS first_pos, coalesce(source_index >= 1 AND source_index <= supplied, false) AS resolved FROM c")
def citations_resolved(spark, d):
    return retrieval.citations(read(spark, d, "grounded_answers"), "answer_id", "answer", "sources_supplied")


@_query(
    f"""WITH {_MARKERS}, u AS (SELECT id, count(*) FILTER (NOT coalesce(source_index >= 1 AND source_index <= supplied, false)) AS unresolved, count(*) AS cited FROM c GROUP BY id)
SELECT answer_id, CASE WHEN coalesce(unresolved, 0) > 0 THEN 'unknown source' ELSE 'no citation' END AS warning FROM grounded_answers LEFT JOIN u ON id = answer_id
WHERE coalesce(unresolved, 0) > 0 OR (coalesce(cited, 0) = 0 AND NOT coalesce(refused, false))"""
)
def citation_warnings(spark, d):
    return answering.citation_warnings(read(spark, d, "grounded_answers"))


@_query(
    """SELECT count(*) AS answers, count(*) FILTER (refused) AS refused, count(*) FILTER (contains(answer, '[S')) AS with_markers, count(*) FILTER (len(warnings) > 0) AS with_warnings,
count(*) FILTER (contains(lower(answer), 'do not contain enough information')) AS declined FROM grounded_answers"""
)
def answer_summary(spark, d):
    return answering.recorded_summary(read(spark, d, "grounded_answers"))


@_query(
    """WITH new AS (SELECT DISTINCT md5(text) AS chunk_id FROM documents WHERE text IS NOT NULL AND source <> 'press_wire'), store AS (SELECT DISTINCT md5(text) AS chunk_id FROM documents WHERE text IS NOT NULL AND source <> 'analyst_note')
SELECT coalesce(n.chunk_id, s.chunk_id) AS chunk_id, CASE WHEN s.chunk_id IS NULL THEN 'add' WHEN n.chunk_id IS NULL THEN 'delete' ELSE 'keep' END AS action FROM new n FULL JOIN store s ON n.chunk_id = s.chunk_id"""
)
def index_sync_plan(spark, d):
    docs = _docs(spark, d).where(F.col("text").isNotNull()).select(F.md5("text").alias("chunk_id"), "source")
    return retrieval.index_sync(docs.where("source <> 'press_wire'").select("chunk_id"), docs.where("source <> 'analyst_note'").select("chunk_id"))


_SYNC_WHOLE = """new AS (SELECT DISTINCT md5(text) AS chunk_id FROM documents WHERE text IS NOT NULL AND source IS DISTINCT FROM 'press_wire'),
store AS (SELECT DISTINCT md5(text) AS chunk_id FROM documents WHERE text IS NOT NULL AND source IS DISTINCT FROM 'analyst_note')"""


@_query(
    f"""WITH {_SYNC_WHOLE}
SELECT coalesce(n.chunk_id, s.chunk_id) AS chunk_id, CASE WHEN s.chunk_id IS NULL THEN 'add' WHEN n.chunk_id IS NULL THEN 'delete' ELSE 'keep' END AS action FROM new n FULL JOIN store s ON n.chunk_id = s.chunk_id"""
)
def index_sync_plan_whole(spark, d):
    """``index_sync_plan`` with the documents without source, which are in both snapshots."""
    docs = _docs(spark, d).where(F.col("text").isNotNull()).select(F.md5("text").alias("chunk_id"), "source")
    without = lambda name: docs.where(~F.col("source").eqNullSafe(name)).select("chunk_id")
    return retrieval.index_sync(without("press_wire"), without("analyst_note"))


@_query(
    """WITH f AS (SELECT company, coalesce(bool_or(contains(upper(company), 'LABS')), false) AS preferred, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS sections FROM documents WHERE text IS NOT NULL GROUP BY company)
SELECT company, preferred, chars, sections FROM f ORDER BY preferred DESC, chars DESC, company NULLS FIRST LIMIT 25"""
)
def filing_priority_whole(spark, d):
    """``filing_priority`` with the documents without company as a group of their own."""
    wanted = F.array(F.lit("LABS"))
    preferred = F.coalesce(F.max(F.exists(wanted, lambda w: F.contains(F.upper("company"), w))), F.lit(False))
    f = _docs(spark, d).where(F.col("text").isNotNull()).groupBy("company").agg(preferred.alias("preferred"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("sections"))
    return f.orderBy(F.col("preferred").desc(), F.col("chars").desc(), F.col("company").asc_nulls_first()).limit(25)


# -- operations -------------------------------------------------------------------------------------------------


@_query("SELECT event_type AS state, count(*) AS events FROM events GROUP BY event_type")
def lineage_by_state(spark, d):
    return lineage.by_state(read(spark, d, "events"), "event_type")


@_query("SELECT user_id % 7 AS job, count(*) FILTER (hour(ts) < 12) AS morning, count(*) FILTER (hour(ts) >= 12) AS evening FROM events GROUP BY 1")
def lineage_pivot(spark, d):
    e = read(spark, d, "events").select((F.col("user_id") % 7).alias("job"), F.when(F.hour("ts") < 12, "morning").otherwise("evening").alias("half"))
    return lineage.summary(e, "job", "half", ("morning", "evening"))


@_query("SELECT event_type AS topic, CAST(sum(hi - lo) AS BIGINT) AS messages FROM (SELECT event_type, user_id % 3 AS part, min(event_id) AS lo, max(event_id) + 1 AS hi FROM events GROUP BY ALL) GROUP BY event_type")
def topic_counts(spark, d):
    return lineage.topic_counts(read(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("part"), "event_id"), "event_type", "part", "event_id")


@_query("WITH " + _BARS + " SELECT DISTINCT ticker FROM bars")
def distinct_tickers(spark, d):
    return _bars(spark, d).select("ticker").distinct()


@_query("WITH " + _BARS + " SELECT * FROM (VALUES ('AAPL'), ('TA'), ('TZ'), ('TB')) w(ticker) WHERE ticker NOT IN (SELECT ticker FROM bars)")
def missing_tickers(spark, d):
    wanted = spark.createDataFrame([(t,) for t in ("AAPL", "TA", "TZ", "TB")], "ticker STRING")
    return wanted.join(_bars(spark, d), "ticker", "left_anti")


@_query("WITH " + _BARS + " SELECT ticker, trade_date, close FROM bars ORDER BY trade_date, ticker LIMIT 1000")
def producer_take(spark, d):
    """The first messages in (date, ticker) order."""
    return _bars(spark, d).select("ticker", "trade_date", "close").orderBy("trade_date", "ticker").limit(1000)


@_query(f"WITH {_DRAWN} SELECT coalesce({_EXPECTED}, 'ACCEPTED') AS outcome, count(*) AS n FROM drawn GROUP BY 1")
def stream_contract_counts(spark, d):
    """A bounded stream of payload files through the contract into two sinks; the answer of the batch."""
    return drain_payloads(_faulty(spark, d), shared_path(spark, "stream"))


@_query("SELECT o_orderpriority, round(sum(CASE WHEN o_totalprice > 0 THEN ln(o_totalprice) END), 4) AS log_sum, count(*) AS orders FROM orders GROUP BY o_orderpriority")
def scalar_logs(spark, d):
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.sum(log_or_null(F.col("o_totalprice"))), 4).alias("log_sum"), F.count("*").alias("orders"))
