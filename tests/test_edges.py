"""Each general operator on nulls in every column, empty and very long texts, ties, repeated rows, empty tables and extra
columns with names that the operators use themselves."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from tickforge.operators import anomalies, late, profile, redelivery, rejects, rolling

QUOTE = (
    "row_id BIGINT, ticker STRING, trade_date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, adj_close DOUBLE, volume BIGINT,"
    " source STRING, event_ts TIMESTAMP_NTZ, ingest_ts TIMESTAMP_NTZ, batch_id STRING"
)
NAMES = [c.split()[0] for c in QUOTE.split(", ")]
T0 = dt.datetime(2024, 1, 5, 21)
CLASHES = ["tk", "bad", "kind", "status", "period", "as_of_date", "shard", "leaf", "field", "usual", "reason", "quote", "feed", "rows", "__row", "h", "c", "n"]


def rows():
    out, ids = [], itertools.count(1)

    def row(**more):
        base = dict(row_id=next(ids), ticker="AB", trade_date=T0.date(), open=10.0, high=11.0, low=9.0, close=10.5, adj_close=10.0, volume=5, source="s", event_ts=T0, ingest_ts=T0, batch_id="b")
        return tuple((base | more)[n] for n in NAMES)

    for n in NAMES[1:]:
        out += [row(**{n: None}), row(**{n: None})]
    out.append(tuple([next(ids)] + [None] * (len(NAMES) - 1)))
    out += [row(ticker=""), row(ticker="  "), row(ticker="x" * 200_000), row(ticker="é\x00Ω"), row(close=float("nan")), row(close=float("inf")), row(volume=2**63 - 1), row(volume=0)]
    out += [row()] * 3  # one row three times, its id too
    return out


@pytest.fixture(params=["rows", "empty", "clashes"])
def quotes(request, spark):
    df = spark.createDataFrame(rows(), QUOTE)
    if request.param == "empty":
        return df.limit(0)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if request.param == "clashes" else df


def test_redelivery(spark, quotes):
    kept = redelivery.keep_first(quotes)
    assert kept.columns == quotes.columns
    n = quotes.select(F.upper(F.regexp_replace("ticker", r"^\s+|\s+$", "")), "trade_date", "event_ts").distinct().count()
    assert kept.count() == n
    clean = quotes.drop("__row")
    lost = redelivery.surplus_rows(clean)
    assert lost.distinct().count() == quotes.select("row_id").distinct().count() - kept.select("row_id").distinct().count()


def test_profile(spark, quotes, tmp_path):
    store = profile.ProfileStore(spark, f"file://{tmp_path}/p")
    store.deliver(quotes)
    m = profile.load_metrics(store.states())
    assert m.count() == 9 * quotes.select("batch_id").distinct().count()
    profile.find_issues(profile.recheck(m, quotes), spark.createDataFrame([], "batch_id STRING, column_name STRING, expectation STRING, unexpected_count BIGINT")).collect()


def test_anomalies(quotes):
    got = {r["row_id"]: r["kind"] for r in anomalies.flag_readings(quotes).collect()}
    assert set(got.values()) <= {"impossible"}


def test_late(spark, quotes, tmp_path):
    store = late.feed(quotes, f"file://{tmp_path}/l")
    usable = quotes.where(F.col("event_ts").isNotNull() & F.col("ingest_ts").isNotNull()).count()
    assert (store.current().agg(F.sum("messages")).first()[0] or 0) == usable and store.apart().count() == 0


def test_rolling(quotes):
    kept = redelivery.keep_first(quotes).where("volume < 1000 OR volume IS NULL")
    out = rolling.rolling_totals(kept)
    assert out.count() == kept.where("trade_date IS NOT NULL").select(F.upper(F.trim("ticker")), "trade_date").distinct().count()


def test_volumes_beyond_64_bits(spark):
    day = lambda k: T0.date() + dt.timedelta(days=k)
    some = [(k, "AB", day(k), 1.0, 1.0, 1.0, 1.0, None, v, "s", T0 + dt.timedelta(days=k), T0 + dt.timedelta(days=k), "b") for k, v in enumerate([2**62, 2**62 - 1, 2**62, -(2**62), 3])]
    got = [r["total_volume_7d"] for r in rolling.rolling_totals(spark.createDataFrame(some, QUOTE)).orderBy("day").collect()]
    assert got == [2**62, 2**63 - 1, None, 2**63 - 1, None]


def test_rejects(spark):
    texts = [None, "", " ", "x" * 300_000, "{" * 5000, '{"ticker":"' + "A" * 300_000 + '"}', "\x00", "é", "a,b", '"', "{}", "[]"]
    df = spark.createDataFrame([(i % 5, t, "clash", "clash") for i, t in enumerate(texts * 2)], "record_id INT, raw_payload STRING, reason STRING, record STRING")
    for frame, n in ((df, 24), (df.limit(0), 0)):
        out = rejects.parse_quotes(frame)
        assert out.count() == n and out.where("reason IS NULL").count() == 0 and out.columns == ["record_id", "raw_payload", "record", "quote", "reason"]
        assert rejects.parse_delimited(frame, "raw_payload", {"a": "string", "b": "bigint"}).where("reason IS NULL").count() == 0
