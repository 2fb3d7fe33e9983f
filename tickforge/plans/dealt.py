"""Queries of the general training-data problems, with SQL to check them where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.scalars import norm_ticker
from tickforge.operators import anomalies, late, profile, redelivery, rejects, rolling
from tickforge.streaming import ingest
from tickforge.streaming.periods import replay
from tickforge.workspace import read, shared_path, written


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return redelivery.keep_first(read(spark, d, "silver_quotes"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return redelivery.surplus_rows(read(spark, d, "silver_quotes"))


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """What the store holds after three deliveries by arrival, each message once."""
    feed = read(spark, d, "silver_quotes")
    store = redelivery.MessageStore(spark, shared_path(spark, "messages"))
    last = feed.agg(F.max("ingest_ts")).first()[0]
    age = F.lit(0) if last is None else F.coalesce(F.datediff(F.lit(last).cast("date"), F.col("ingest_ts").cast("date")), F.lit(0))
    part = F.when(age > 60, 0).when(age > 30, 1).otherwise(2)
    for k in range(3):
        store.deliver(feed.where(part == k))
    return store.winners().select("row_id")


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics from the stored states of two deliveries: all arrivals but those of the last 30 days, and these."""
    loads = read(spark, d, "silver_backfill")
    store = profile.ProfileStore(spark, shared_path(spark, "profile"))
    last = loads.agg(F.max("ingest_ts")).first()[0]
    early = F.lit(True) if last is None else F.coalesce(F.col("ingest_ts") < F.lit(last) - F.expr("INTERVAL 30 DAYS"), F.lit(True))
    store.deliver(loads.where(early))
    store.deliver(loads.where(~early))
    return profile.recheck(written(profile.load_metrics(store.states()), "metrics"), loads)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.find_issues(_metrics(spark, d), read(spark, d, "quality_gate"))


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    m = profile.profile_with_usual(_metrics(spark, d))
    return m.select("batch_id", "column_name", "feed", "rows", "null_share", "distinct_values", "median_value", "null_rows", "outside_rows")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parsed = rejects.parse_quotes(read(spark, d, "bronze_quotes").select("record_id", "raw_payload"))
    return rejects.rejected(parsed, ["record_id"])


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    parsed = rejects.parse_quotes(read(spark, d, "bronze_quotes").select("record_id", "raw_payload"))
    return rejects.accepted(parsed, ["record_id"])


def p3_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The raw messages as a topic through the stream: record_id, reason of what stands in quarantine."""
    root = shared_path(spark, "raw")
    raw = read(spark, d, "bronze_quotes")
    ingest.produce(raw, f"{root}/topic", key="record_id", order="record_id")
    ingest.run_ingest(spark, f"{root}/topic", root)
    return ingest.read_quarantine(spark, root).select(F.col("kafka.key").cast("bigint").alias("record_id"), "reason")


_LINE = {"row_id": "bigint", "ticker": "string", "trade_date": "date", "close": "double", "volume": "bigint"}


def p3_delimited(spark: SparkSession, d: str) -> DataFrame:
    """Quotes as delimited lines, some with a column too few or too many, an open quotation, a cell that is no number or no
    ticker, through the reader."""
    q = read(spark, d, "silver_quotes").select(*_LINE)
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _LINE}
    fault = F.col("row_id") % 23
    text["ticker"] = F.when(fault == 5, "").when(fault == 7, F.concat(F.lit('"'), F.col("ticker"), F.lit(',x"'))).when(fault == 11, F.concat(F.lit('"'), F.col("ticker"))).otherwise(text["ticker"])
    text["volume"] = F.when(fault == 13, "many").otherwise(text["volume"])
    line = F.concat_ws(",", *text.values())
    line = F.when(fault == 1, F.regexp_replace(line, r",[^,]*\z", "")).when(fault == 3, F.concat(line, F.lit(",more"))).otherwise(line)
    got = rejects.parse_delimited(q.select("row_id", line.alias("line")), "line", _LINE, required=("ticker",))
    return got.select("row_id", "reason", *[F.col(f"record.{c}").alias(c) for c in list(_LINE)[1:]])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    quotes = read(spark, d, "silver_quotes").select("row_id", "ticker", "trade_date", "event_ts", "ingest_ts", *anomalies.PRICES, "volume")
    return anomalies.flag_readings(redelivery.keep_first(quotes))


def _period_feed(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "silver_quotes").select("row_id", "ticker", "trade_date", "event_ts", "ingest_ts", "high", "low", "close", "volume")


def _periods(spark: SparkSession, d: str) -> late.PeriodStore:
    return late.feed(written(redelivery.keep_first(_period_feed(spark, d)), "kept"), shared_path(spark, "periods"))


def p4_scored(spark: SparkSession, d: str) -> DataFrame:
    """Every finding with its field and standardised innovation."""
    quotes = read(spark, d, "silver_quotes").select("row_id", "ticker", "trade_date", "event_ts", "ingest_ts", *anomalies.PRICES, "volume")
    return anomalies.scored_readings(redelivery.keep_first(quotes))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _periods(spark, d).apart().select("row_id", "status")


def p6_daily_as_of(spark: SparkSession, d: str) -> DataFrame:
    return _periods(spark, d).log()


def p6_expired_report(spark: SparkSession, d: str) -> DataFrame:
    return late.expired_report(_periods(spark, d).apart("expired")).select("ticker", "period", "dropped")


def p6_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The final periods of the feed with all its copies, streamed in three micro-batches."""
    return replay(_period_feed(spark, d), shared_path(spark, "stream")).current()


def _day_values(spark: SparkSession, d: str) -> DataFrame:
    return redelivery.keep_first(read(spark, d, "silver_quotes").select("row_id", "ticker", "trade_date", "event_ts", "ingest_ts", "close", "volume"))


def p7_rolling_totals(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rolling_totals(_day_values(spark, d))


def p7_corrected(spark: SparkSession, d: str) -> DataFrame:
    """The same, as trees of all arrivals but those of the last 30 days, corrected by these."""
    kept = written(_day_values(spark, d), "kept")
    last = kept.agg(F.max("ingest_ts")).first()[0]
    early = F.lit(True) if last is None else F.coalesce(F.col("ingest_ts") < F.lit(last) - F.expr("INTERVAL 30 DAYS"), F.lit(False))
    trees = written(rolling.build_trees(rolling.day_quotes(kept.where(early))), "trees")
    key = [norm_ticker(F.col("ticker")).alias("__t"), F.col("trade_date").alias("__d")]
    touched = kept.where(~early).select(*key).distinct()
    again = kept.join(touched, norm_ticker(F.col("ticker")).eqNullSafe(F.col("__t")) & (F.col("trade_date") == F.col("__d")), "left_semi")
    return rolling.trailing(written(rolling.apply_corrections(trees, rolling.day_quotes(again)), "trees"))


QUERIES = {
    f.__name__: f for f in (p1_found, p1_kept, p2_found, p2_profile, p3_found, p3_loaded, p3_streamed, p3_delimited, p4_found, p4_scored, p6_found, p6_daily_as_of, p6_expired_report, p6_streamed, p7_rolling_totals, p7_corrected)
}

# -- SQL --------------------------------------------------------------------------------------------------------

_NORM = r"upper(regexp_replace(regexp_replace(ticker, '^\s+', ''), '\s+$', ''))"
_KEPT = f"""kept AS (
  SELECT * FROM (
    SELECT *, {_NORM} AS tk,
           row_number() OVER (PARTITION BY {_NORM}, trade_date, event_ts ORDER BY ingest_ts NULLS LAST, row_id) AS rn
    FROM silver_quotes) WHERE rn = 1)"""

_COLUMNS = ("ticker", "open", "high", "low", "close", "adj_close", "volume", "event_ts")
_NUMERIC = _COLUMNS[1:7]


def _out(c: str) -> str:
    return f"count(*) FILTER ({c} < 0)" if c == "volume" else f"count(*) FILTER ({c} <= 0 OR isnan({c}))"


def _profile_sql(columns) -> str:
    parts = []
    for c in columns:
        numeric = c in _NUMERIC
        unmatched = r"count(*) FILTER (NOT regexp_full_match(ticker, '[A-Z]{1,6}([.\-][A-Z]{1,2})?'))" if c == "ticker" else "NULL"
        parts.append(f"""SELECT batch_id, '{c}' AS column_name, mode_source AS feed, count(*) AS n, count(*) FILTER ({c} IS NULL) AS null_rows,
  count(DISTINCT {c}) AS distinct_values, {f"CAST(median({c}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"} AS median_value,
  CAST({unmatched} AS BIGINT) AS unmatched, CAST({_out(c) if numeric else "NULL"} AS BIGINT) AS outside_rows
FROM fed GROUP BY batch_id, mode_source""")
    return f"""feeds AS (
  SELECT batch_id, arg_max(source, (n, rk)) AS mode_source FROM (
    SELECT batch_id, source, n, row_number() OVER (PARTITION BY batch_id ORDER BY source DESC) AS rk FROM (
      SELECT batch_id, source, count(*) AS n FROM silver_backfill WHERE source IS NOT NULL GROUP BY ALL)) GROUP BY batch_id),
fed AS (SELECT b.*, f.mode_source FROM silver_backfill b LEFT JOIN feeds f USING (batch_id)),
prof AS ({" UNION ALL ".join(parts)})"""


_P2_FOUND = f"""WITH {_profile_sql((*_COLUMNS, "trade_date"))},
m AS (SELECT *, null_rows / n AS null_share, unmatched / nullif(n - null_rows, 0) AS unmatched_share, outside_rows / nullif(n - null_rows, 0) AS outside_share FROM prof),
u AS (SELECT feed, column_name, median(null_share) AS u_null, median(unmatched_share) AS u_un, median(median_value) AS u_med, median(distinct_values) AS u_dis
      FROM m GROUP BY feed, column_name),
j AS (SELECT m.*, u_null, u_un, u_med, u_dis FROM m JOIN u ON m.feed IS NOT DISTINCT FROM u.feed AND m.column_name = u.column_name WHERE m.column_name <> 'trade_date')
SELECT batch_id, column_name, 'nulls' AS issue FROM j WHERE null_share - u_null >= 0.15 - 1e-12
UNION ALL SELECT batch_id, column_name, 'pattern' FROM j WHERE unmatched_share - u_un >= 0.15 - 1e-12
UNION ALL SELECT batch_id, column_name, 'range' FROM j WHERE outside_share >= 0.05
UNION ALL SELECT batch_id, column_name, 'shift' FROM j WHERE u_med <> 0 AND (median_value / u_med >= 2 OR median_value / u_med <= 0.5)
UNION ALL SELECT batch_id, column_name, 'distinct' FROM j WHERE distinct_values < 0.5 * u_dis
UNION ALL SELECT DISTINCT m.batch_id, m.column_name, 'miscount' FROM m JOIN quality_gate g ON g.batch_id = m.batch_id AND g.column_name = m.column_name
  WHERE g.unexpected_count IS NOT NULL AND g.unexpected_count <> CASE WHEN g.expectation LIKE '%to_not_be_null' THEN null_rows WHEN g.expectation LIKE '%to_be_between' THEN outside_rows END"""


def _p4_sql() -> str:
    """Spikes and stuck runs by window functions over every message."""
    bad = " OR ".join([*[f"{p} <= 0 OR isnan({p})" for p in ("open", "high", "low", "close")], "high < low", "volume < 0", "open > high", "close > high", "open < low", "close < low"])
    ctes, picks = [], []
    for f in ("close", "high", "low", "volume"):
        w = "OVER (PARTITION BY tk ORDER BY trade_date NULLS FIRST, event_ts NULLS FIRST)"
        ctes.append(f"s_{f} AS (SELECT tk, row_id, y, row_number() {w} AS p, abs(y - lag(y) {w}) AS step FROM (SELECT tk, row_id, trade_date, event_ts, ln(CAST({f} AS DOUBLE)) AS y FROM big WHERE {f} > 0))")
        ctes.append(f"u_{f} AS (SELECT tk, median(step) AS usual FROM s_{f} GROUP BY tk)")
        for g in (1, 2, 3):
            v = "OVER (PARTITION BY tk ORDER BY p)"
            inner = ", ".join(["y", *[f"lead(y, {j}) {v}" for j in range(1, g)]])
            ctes.append(f"g_{f}{g} AS (SELECT tk, p, least({inner}) AS lo, greatest({inner}) AS hi, lag(y) {v} AS a, lead(y, {g}) {v} AS b FROM s_{f})")
            ctes.append(
                f"h_{f}{g} AS (SELECT x.tk, x.p FROM g_{f}{g} x JOIN u_{f} u ON x.tk IS NOT DISTINCT FROM u.tk WHERE a IS NOT NULL AND b IS NOT NULL "
                f"AND greatest(lo - greatest(a, b), least(a, b) - hi) >= 12 * usual AND greatest(lo - greatest(a, b), least(a, b) - hi) > 0)"
            )
            picks.append(f"SELECT s.row_id, 'spike' AS kind FROM s_{f} s JOIN (SELECT tk, unnest(range(p, p + {g})) AS p FROM h_{f}{g}) h ON s.p = h.p AND s.tk IS NOT DISTINCT FROM h.tk")
    for f in ("close", "volume"):
        w = "OVER (PARTITION BY tk ORDER BY trade_date NULLS FIRST, event_ts NULLS FIRST)"
        ctes.append(f"r_{f} AS (SELECT *, sum(brk) {w} AS run FROM (SELECT *, CASE WHEN {f} = lag({f}) {w} AND volume > 0 AND lag(volume) {w} > 0 THEN 0 ELSE 1 END AS brk FROM big))")
        picks.append(f"SELECT row_id, 'stuck' AS kind FROM (SELECT row_id, {f}, volume, count(*) OVER (PARTITION BY tk, run) AS len FROM r_{f}) WHERE len >= 6 AND {f} IS NOT NULL AND volume > 0")
    return f"""WITH {_KEPT}, judged AS (SELECT *, coalesce({bad}, false) AS bad FROM kept),
big AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY tk) AS n FROM judged WHERE NOT bad) WHERE n >= 30),
{", ".join(ctes)}
SELECT row_id, min(kind) AS kind FROM ({" UNION ALL ".join(picks)} UNION ALL SELECT row_id, 'impossible' FROM judged WHERE bad) GROUP BY row_id"""


_ROUTED = f"""{_KEPT}, routed AS (
  SELECT *, CAST(event_ts AS DATE) AS period, greatest(CAST(event_ts AS DATE), CAST(ingest_ts AS DATE)) AS as_of_date,
         CASE WHEN ingest_ts - event_ts > INTERVAL 168 HOURS THEN 'expired' WHEN CAST(ingest_ts AS DATE) > CAST(event_ts AS DATE) THEN 'late' ELSE 'on_time' END AS status
  FROM kept WHERE event_ts IS NOT NULL AND ingest_ts IS NOT NULL)"""


_DAILY = f"""WITH {_ROUTED}, st AS (
  SELECT tk AS ticker, period, as_of_date, count(*) AS messages, count(*) FILTER (status = 'late') AS late_messages, sum(volume) AS volume, max(high) AS high, min(low) AS low,
         max({{'e': event_ts, 'r': row_id, 'c': close}}) AS lq
  FROM routed WHERE status <> 'expired' GROUP BY ALL)
SELECT ticker, period, as_of_date, CAST(sum(messages) OVER w AS BIGINT) AS messages, CAST(sum(late_messages) OVER w AS BIGINT) AS late_messages, CAST(sum(volume) OVER w AS BIGINT) AS volume,
       max(high) OVER w AS high, min(low) OVER w AS low, as_of_date = max(as_of_date) OVER (PARTITION BY ticker, period) AS is_final, (max(lq) OVER w).c AS close
FROM st WINDOW w AS (PARTITION BY ticker, period ORDER BY as_of_date ROWS UNBOUNDED PRECEDING)"""


def _p7_sql() -> str:
    """Sums of close carry what each addition rounds off, as those of the trees do; a plain sum differs in the last digit."""
    t = "(a.s + b.s)"
    add = f"lambda a, b: {{'s': {t}, 'c': a.c + b.c + CASE WHEN isfinite({t}) THEN (a.s - ({t} - ({t} - a.s))) + (b.s - ({t} - a.s)) ELSE 0.0 END}}"
    out, sums = [], []
    for w in (7, 30):
        over = f"OVER (PARTITION BY ticker ORDER BY day RANGE BETWEEN INTERVAL {w - 1} DAYS PRECEDING AND CURRENT ROW)"
        sums.append(f"list_reduce(list_transform(list(close) FILTER (close IS NOT NULL) {over}, lambda x: {{'s': x, 'c': 0.0::DOUBLE}}), {add}) AS r{w}")
        total = f"CASE WHEN isfinite(r{w}.s) THEN r{w}.s + r{w}.c ELSE r{w}.s END"
        sums += [f"CAST(sum(volume) {over} AS BIGINT) AS total_volume_{w}d", f"CAST(sum(volume) {over} AS DOUBLE) / count(volume) {over} AS avg_volume_{w}d", f"count(close) {over} AS n_close_{w}d", f"count(volume) {over} AS n_volume_{w}d"]
        out.append(f"{total} AS total_close_{w}d, ({total}) / n_close_{w}d AS avg_close_{w}d, total_volume_{w}d, avg_volume_{w}d, n_close_{w}d, n_volume_{w}d")
    return f"""WITH {_KEPT}, q AS (
  SELECT * FROM (SELECT tk, trade_date, close, volume, row_number() OVER (PARTITION BY tk, trade_date ORDER BY event_ts DESC NULLS LAST, row_id DESC) AS pick FROM kept WHERE trade_date IS NOT NULL) WHERE pick = 1),
days AS (SELECT tk AS ticker, CAST(unnest(generate_series(min(trade_date), max(trade_date), INTERVAL 1 DAY)) AS DATE) AS day FROM q GROUP BY tk),
f AS (SELECT d.ticker, d.day, q.close, q.volume FROM days d LEFT JOIN q ON q.tk IS NOT DISTINCT FROM d.ticker AND q.trade_date = d.day),
g AS (SELECT ticker, day, {", ".join(sums)} FROM f)
SELECT ticker, day, {", ".join(out)} FROM g"""


SQL = {
    "p1_found": f"""SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY {_NORM}, trade_date, event_ts ORDER BY ingest_ts NULLS LAST, row_id) AS rn
FROM silver_quotes) WHERE rn > 1""",
    "p1_kept": f"WITH {_KEPT} SELECT row_id FROM kept",
    "p2_found": _P2_FOUND,
    "p2_profile": f"""WITH {_profile_sql(_COLUMNS + ("trade_date",))}
SELECT batch_id, column_name, feed, n AS rows, null_rows / n AS null_share, distinct_values, median_value, null_rows, outside_rows FROM prof""",
    "p3_delimited": """WITH f AS (SELECT row_id, row_id % 23 AS k, ticker, trade_date, close, volume FROM silver_quotes),
r AS (SELECT *, CASE WHEN k IN (1, 3) THEN 'COLUMN_COUNT' WHEN k = 11 AND ticker IS NOT NULL THEN 'BROKEN_QUOTING' WHEN k = 5 OR coalesce(ticker, '') = '' THEN 'MISSING_VALUE:ticker'
  WHEN isnan(close) OR isinf(close) THEN 'INVALID_VALUE:close' WHEN k = 13 THEN 'INVALID_VALUE:volume' END AS reason FROM f)
SELECT row_id, reason, CASE WHEN reason IS NULL THEN CASE WHEN k = 7 THEN ticker || ',x' ELSE ticker END END AS ticker, CASE WHEN reason IS NULL THEN trade_date END AS trade_date,
  CASE WHEN reason IS NULL THEN close END AS close, CASE WHEN reason IS NULL THEN volume END AS volume FROM r""",
    "p4_found": _p4_sql(),
    "p6_found": f"WITH {_ROUTED} SELECT row_id, status FROM routed WHERE status <> 'on_time'",
    "p6_daily_as_of": _DAILY,
    "p6_streamed": f"SELECT ticker, period, as_of_date, messages, late_messages, volume, high, low, close FROM ({_DAILY}) WHERE is_final",
    "p6_expired_report": f"WITH {_ROUTED} SELECT tk AS ticker, period, count(*) AS dropped FROM routed WHERE status = 'expired' GROUP BY ALL",
    "p7_rolling_totals": _p7_sql(),
    "p7_corrected": _p7_sql(),
}
