"""The general training-data operators against brute force, and their defined edge cases."""

import datetime as dt
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickforge.operators import anomalies, late, profile, redelivery, rejects, rolling
from tickforge.operators.quantiles import grouped_median

QUOTE = (
    "row_id BIGINT, ticker STRING, trade_date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, adj_close DOUBLE, volume BIGINT,"
    " source STRING, event_ts TIMESTAMP_NTZ, ingest_ts TIMESTAMP_NTZ, batch_id STRING"
)
DAY = dt.date(2024, 1, 1)


def quote(i, ticker="AB", day=0, close=10.0, volume=100, event=dt.datetime(2024, 1, 1, 21), ingest=dt.datetime(2024, 1, 2), **more):
    row = dict(
        row_id=i, ticker=ticker, trade_date=DAY + dt.timedelta(days=day) if day is not None else None, open=close, high=close, low=close, close=close,
        adj_close=None, volume=volume, source="s", event_ts=event, ingest_ts=ingest, batch_id="b",
    )
    return tuple((row | more).values())


def frame(spark, rows):
    return spark.createDataFrame(rows, QUOTE)


# -- medians ----------------------------------------------------------------------------------------------------


def test_grouped_median_equals_numpy(spark):
    rng = random.Random(1)
    rows = [(k, v) for k in ("a", "b", None) for v in [rng.choice([-1e3, -0.5, 0.0, 1e-9, 2.0, 2.0, 3.5, 1e6]) * rng.random() for _ in range(rng.randint(1, 60))]]
    rows += [("nan", float("nan")), ("none", None), ("same", 7.0), ("same", 7.0)]
    got = {r["k"]: r["median"] for r in grouped_median(spark.createDataFrame(rows, "k STRING, v DOUBLE"), ["k"], "v").collect()}
    want = {k: float(np.median([v for kk, v in rows if kk == k])) for k in ("a", "b", None, "same")}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


# -- redelivery -------------------------------------------------------------------------------------------------


def test_surplus_rows_over_two_deliveries(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        quote(1, ingest=t + dt.timedelta(days=1)),
        quote(2, ticker=" ab\t", ingest=t + dt.timedelta(days=90)),  # a late copy of 1
        quote(3, day=1, event=None, ingest=t + dt.timedelta(days=90)),
        quote(4, day=1, event=None, ingest=t + dt.timedelta(days=2)),  # null agrees with null; earlier than 3
        quote(5, day=2, ingest=t + dt.timedelta(days=5)),
        quote(6, day=2, ingest=t + dt.timedelta(days=5)),  # tie: the smaller row_id stays
        quote(7, day=None, ticker=None, ingest=t + dt.timedelta(days=91)),
        quote(8, day=3, ingest=None),  # null arrival comes last
        quote(9, day=3, ingest=t + dt.timedelta(days=91)),
    ]
    df = frame(spark, rows).withColumn("__new", F.lit("a clashing name"))
    assert sorted(r[0] for r in redelivery.surplus_rows(df.drop("__new")).collect()) == [2, 3, 6, 8]
    kept = {r["row_id"] for r in redelivery.keep_first(df).collect()}
    assert kept == {1, 4, 5, 7, 9}


def test_store_touches_only_affected_partitions_and_takes_earlier_copies(spark, tmp_path):
    t = dt.datetime(2024, 1, 10)
    store = redelivery.MessageStore(spark, f"file://{tmp_path}/store")
    month = dt.timedelta(days=31)
    first = store.deliver(frame(spark, [quote(1, day=0, ingest=t), quote(2, day=1, ingest=t + month), quote(3, day=2, ingest=t + 2 * month)]))
    assert first.count() == 0
    before = store.table.manifest()["parts"]
    lost = store.deliver(frame(spark, [quote(4, day=1, ingest=t + 3 * month), quote(5, day=2, ingest=t - month)]))
    assert sorted(r[0] for r in lost.collect()) == [3, 4]
    after = store.table.manifest()["parts"]
    assert after["2024-01"] == before["2024-01"]  # not affected, not rewritten
    assert after["2024-02"] != before["2024-02"] and after["2024-03"] != before["2024-03"]
    assert {r["row_id"] for r in store.winners().collect()} == {1, 2, 5}
    assert store.deliver(frame(spark, [])).count() == 0
    new = store.deliver(frame(spark, [quote(6, day=9, ingest=t)]))  # a new message of a stored period: added, nothing rewritten
    assert new.count() == 0 and store.table.manifest()["parts"]["2024-01"][: len(after["2024-01"])] == after["2024-01"]
    assert store.table.manifest()["metrics"]["replacedPartitions"] == 0
    for k in range(store.MOST_FOLDERS + 2):  # many small deliveries: folders stay few, every copy is still found
        assert sorted(r[0] for r in store.deliver(frame(spark, [quote(100 + k, day=20 + k, ingest=t), quote(200 + k, day=9, ingest=t + month)])).collect()) == [200 + k]
    m = store.table.manifest()
    assert len(m["parts"]["2024-01"]) <= store.MOST_FOLDERS + 1 and max(map(len, m["side"]["index"].values())) <= store.MOST_FOLDERS + 1


def test_a_delivery_that_fails_before_its_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    store = redelivery.MessageStore(spark, f"file://{tmp_path}/store")
    store.deliver(frame(spark, [quote(1, day=0)]))
    monkeypatch.setattr(type(store.table), "put", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.deliver(frame(spark, [quote(2, day=1)]))
    monkeypatch.undo()
    assert store.deliver(frame(spark, [quote(2, day=1)])).count() == 0  # neither the message nor its index entry was there
    assert sorted(r[0] for r in store.deliver(frame(spark, [quote(3, day=1), quote(4, day=0)])).collect()) == [3, 4]


def test_redelivery_of_an_empty_table(spark):
    assert redelivery.surplus_rows(frame(spark, [])).count() == 0
    assert redelivery.keep_first(frame(spark, [])).count() == 0


# -- profile ----------------------------------------------------------------------------------------------------


def test_profile_issues(spark):
    rows, i = [], itertools.count(1)
    for b in range(5):
        for k in range(20):
            rows.append(quote(next(i), ticker=f"T{'ABCDEFGHIJ'[k % 10]}", close=10.0 + k, batch_id=f"b{b}"))
    for k in range(20):  # a bad load: half null closes, low-case tickers, few values, doubled volume
        rows.append(quote(next(i), ticker="ta", close=None if k % 2 else -1.0, volume=300, batch_id="bad"))
    gate = spark.createDataFrame([("b0", "close", "expect_column_values_to_not_be_null", 3), ("b0", "open", "expect_column_values_to_not_be_null", 0), ("bad", "close", "expect_column_values_to_not_be_null", 10)], "batch_id STRING, column_name STRING, expectation STRING, unexpected_count BIGINT")
    m = profile.load_metrics(profile.load_states(frame(spark, rows)))
    got = {tuple(r) for r in profile.find_issues(m, gate).collect()}
    assert {("bad", "close", "nulls"), ("bad", "close", "range"), ("bad", "ticker", "pattern"), ("bad", "volume", "shift"), ("bad", "ticker", "distinct"), ("b0", "close", "miscount")} <= got
    assert {g[0] for g in got if g[2] != "miscount"} == {"bad"}
    assert ("bad", "close", "miscount") not in got and ("b0", "open", "miscount") not in got


def test_states_of_parts_merge_to_the_state_of_the_whole(spark):
    rng = random.Random(2)
    df = frame(spark, [quote(k, ticker=rng.choice(["AA", "BB", "c", None]), close=rng.choice([None, -1.0, rng.random() * 9]), batch_id="x") for k in range(101)])
    parts = profile.load_states(df.where("row_id % 3 = 0")).unionByName(profile.load_states(df.where("row_id % 3 <> 0")))
    merged = profile.merge_states(parts, ["batch_id"]).withColumn("feed", F.lit("s"))
    key = lambda r: r["column_name"]
    a, b = (sorted(profile.load_metrics(s).collect(), key=key) for s in (merged, profile.load_states(df)))
    assert a == b
    assert profile.find_issues(profile.load_metrics(profile.load_states(frame(spark, []))), None).count() == 0


def test_stored_states_of_deliveries_equal_one_scan(spark, tmp_path):
    rng = random.Random(12)
    df = frame(spark, [quote(k, ticker=rng.choice(["AA", "BB", "c", None]), close=rng.choice([None, -1.0, rng.random() * 9]), batch_id=rng.choice(["x", "y", "z"])) for k in range(150)])
    store = profile.ProfileStore(spark, f"file://{tmp_path}/p")
    assert store.deliver(df.where("row_id % 3 = 0"))["mergedBuckets"] == 0
    assert store.deliver(df.where("row_id % 3 <> 0"))["mergedBuckets"] > 0
    key = lambda r: (r["batch_id"], r["column_name"])
    a, b = (sorted(profile.load_metrics(s).collect(), key=key) for s in (store.states().select(profile.load_states(df).columns), profile.load_states(df)))
    assert a == b
    before = store.table.manifest()["parts"]
    assert store.deliver(df.limit(20).withColumn("batch_id", F.lit("new")))["mergedBuckets"] == 0 and all(store.table.manifest()["parts"][p][: len(d)] == d for p, d in before.items())


def test_close_calls_of_large_loads_are_counted_exactly(spark):
    """A load of 12,000 rows whose distinct count is just below half the usual one, and whose median is just below twice."""
    n = 12000
    value = lambda k, b: float(k % 6000) + 1 if b < 3 else float(k % 2999) * 4.0 + 2.0
    df = spark.range(4 * n).select((F.col("id") % 4).alias("b"), F.floor(F.col("id") / 4).alias("k"))
    close = F.when(F.col("b") < 3, F.col("k") % 6000 + 1).otherwise((F.col("k") % 2999) * 4 + 2).cast("double")
    cols = [f.name for f in frame(spark, []).schema]
    rows = df.select(F.concat(F.lit("load"), F.col("b").cast("string")).alias("batch_id"), close.alias("close"), F.lit("s").alias("source"))
    rows = rows.select(*[F.col(c) if c in ("batch_id", "close", "source") else F.lit(None).cast(frame(spark, []).schema[c].dataType).alias(c) for c in cols])
    metrics = profile.recheck(profile.load_metrics(profile.load_states(rows)), rows)
    got = {(r["batch_id"], r["column_name"]): r for r in metrics.collect()}
    assert got["load3", "close"]["distinct_values"] == 2999
    assert ("load3", "close", "distinct") in {tuple(r) for r in profile.find_issues(metrics).collect()}
    assert got["load3", "close"]["median_value"] == float(np.median([value(k, 3) for k in range(n)]))


# -- rejects ----------------------------------------------------------------------------------------------------

GOOD = {"ticker": "QX", "trade_date": "2022-03-09", "open": 41.5, "high": 44.25, "low": 40.75, "close": 42.0, "adj_close": 39.5, "volume": 5100}
CASES = [
    (json.dumps(GOOD), None),
    (None, "MALFORMED_JSON"), ("", "MALFORMED_JSON"), ("{", "MALFORMED_JSON"), (json.dumps(GOOD)[:40], "MALFORMED_JSON"),
    ("[1, 2]", "WRONG_TYPE"), ('"text"', "WRONG_TYPE"), ("3", "WRONG_TYPE"), ("null", "WRONG_TYPE"),
    *[(json.dumps(GOOD | x), r) for x, r in [
        ({"ticker": " brk.b "}, None), ({"ticker": "BF-B"}, None), ({"ticker": "???"}, "INVALID_TICKER"), ({"ticker": None}, "INVALID_TICKER"), ({"ticker": True}, "INVALID_TICKER"), ({"ticker": "A\n"}, None),
        ({"open": "41.5"}, None), ({"open": True}, "OHLC_INCONSISTENT"), ({"open": "NaN"}, "NON_POSITIVE_PRICE"), ({"open": float("nan")}, "NON_POSITIVE_PRICE"), ({"high": "inf"}, None), ({"open": [1]}, "WRONG_TYPE"),
        ({"open": "4_1.5"}, None), ({"open": "12,5"}, "WRONG_TYPE"), ({"close": 0}, "NON_POSITIVE_PRICE"), ({"close": None}, "WRONG_TYPE"), ({"adj_close": None}, None), ({"adj_close": -1}, "NON_POSITIVE_PRICE"),
        ({"volume": 3.0}, None), ({"volume": " 3 "}, None), ({"volume": "3.00"}, None), ({"volume": 3.5}, "WRONG_TYPE"), ({"volume": "3.5"}, "WRONG_TYPE"), ({"volume": -1}, "NEGATIVE_VOLUME"), ({"volume": 0}, None), ({"volume": 10**25}, None),
        ({"trade_date": "2022-03-09T00:00:00"}, None), ({"trade_date": "2022-03-09T00:00:01"}, "INVALID_TIMESTAMP"), ({"trade_date": 1646784000}, None), ({"trade_date": 1646784001}, "INVALID_TIMESTAMP"), ({"trade_date": "2021-6-5"}, "INVALID_TIMESTAMP"),
        ({"trade_date": "2021-02-30"}, "INVALID_TIMESTAMP"), ({"trade_date": "2999-01-01"}, "FUTURE_DATED"), ({"trade_date": ""}, "INVALID_TIMESTAMP"),
        ({"source": 5}, "UNKNOWN"), ({"event_ts": "soon"}, "UNKNOWN"), ({"event_ts": "2022-03-09T21:00:00+00:00"}, None), ({"note": "x"}, "WRONG_TYPE"), ({"high": 1}, "OHLC_INCONSISTENT"),
        ({"ticker": "x\x1fy\"z,\n"}, "INVALID_TICKER"), ({"source": "a\"b\x1fc\nd" + "é" * 5000}, None),
    ]],
    *[(json.dumps({k: v for k, v in GOOD.items() if k != drop}), r) for drop, r in [("ticker", "MISSING_FIELD"), ("close", "MISSING_FIELD"), ("adj_close", None), ("volume", "MISSING_FIELD")]],
    ('{"ticker":"bad?", ' + json.dumps(GOOD)[1:], None),  # the last of two equal keys counts
]


def test_contract_reasons(spark):
    df = spark.createDataFrame([(i, p, "clash") for i, (p, _) in enumerate(CASES)], "record_id INT, raw_payload STRING, reason STRING")
    out = rejects.parse_quotes(df)
    got = {r["record_id"]: r["reason"] for r in out.select("record_id", "reason").collect()}
    assert [(CASES[i][0], got[i]) for i in range(len(CASES)) if got[i] != CASES[i][1]] == []
    loaded = rejects.accepted(out, ["record_id"]).where("record_id = 0").first()
    assert (loaded["ticker"], loaded["trade_date"], loaded["close"], loaded["volume"]) == ("QX", dt.date(2022, 3, 9), 42.0, 5100)
    assert rejects.parse_quotes(df.limit(0)).count() == 0


def test_delimited_lines(spark):
    lines = ["a,1.5,2024-01-01,7", '"x,y",2,2024-01-02,8', "a,1.5", "a,b,c,d,e", 'a,"1,2024-01-01,7', "a,x,2024-01-01,7", "a,1,2024-02-31,7", ",1,2024-01-01,7", "a,,2024-01-01,", None, "  "]
    df = spark.createDataFrame(list(enumerate(lines)), "id INT, line STRING")
    out = rejects.parse_delimited(df, "line", {"name": "string", "px": "double", "day": "date", "n": "bigint"}, required=("name",))
    got = {r["id"]: r["reason"] for r in out.collect()}
    assert got == {0: None, 1: None, 2: "COLUMN_COUNT", 3: "COLUMN_COUNT", 4: "BROKEN_QUOTING", 5: "INVALID_VALUE:px", 6: "INVALID_VALUE:day", 7: "MISSING_VALUE:name", 8: None, 9: "COLUMN_COUNT", 10: "COLUMN_COUNT"}
    assert out.where("id = 1").first()["record"].asDict() == {"name": "x,y", "px": 2.0, "day": dt.date(2024, 1, 2), "n": 8}


# -- anomalies --------------------------------------------------------------------------------------------------


def brute_flags(rows):
    """Plain Python over (row_id, ticker, day, open, high, low, close, volume)."""
    out, by = {}, {}
    for r in rows:
        i, tk, day, o, h, lo, c, v = r
        prices = [x for x in (o, h, lo, c) if x is not None]
        bad = any(x <= 0 or x != x for x in prices) or (v is not None and v < 0) or (h is not None and lo is not None and h < lo)
        bad = bad or any(x is not None and ((h is not None and x > h) or (lo is not None and x < lo)) for x in (o, c))
        if bad:
            out[i] = "impossible"
        else:
            by.setdefault(tk, []).append(r)
    for rs in by.values():
        if len(rs) < 30:
            continue
        rs.sort(key=lambda r: r[2])
        for f in (6, 4, 5, 7):
            s = [(r[0], math.log(r[f])) for r in rs if r[f]]
            if len(s) < 3:
                continue
            usual = float(np.median([abs(b[1] - a[1]) for a, b in itertools.pairwise(s)]))
            for g in (1, 2, 3):
                for k in range(1, len(s) - g):
                    mid = [x[1] for x in s[k : k + g]]
                    a, b = s[k - 1][1], s[k + g][1]
                    d = max(min(mid) - max(a, b), min(a, b) - max(mid))
                    if d >= 12 * usual and d > 0:
                        out.update({x[0]: "spike" for x in s[k : k + g]})
        for f in (6, 7):
            for _, run in itertools.groupby(rs, key=lambda r: (r[f], bool(r[7] and r[7] > 0))):
                run = list(run)
                if len(run) >= 6 and run[0][f] is not None and run[0][7]:
                    for r in run:
                        out.setdefault(r[0], "stuck")
    return out


@pytest.mark.parametrize("shard", [anomalies.SHARD, 64])
def test_flags_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(anomalies, "SHARD", shard)
    rng = random.Random(4)
    rows, i = [], itertools.count(1)
    for tk, n in (("AA", 400), ("BB", 90), ("CC", 25), (None, 60)):
        px, vol = 50.0, 1e5
        for day in range(n):
            px *= math.exp(rng.gauss(0, 0.01) + (0.4 if rng.random() < 0.01 else 0))  # with lasting jumps
            vol *= math.exp(rng.gauss(0, 0.1))
            c = px * (rng.choice([4, 0.2]) if rng.random() < 0.03 else 1)
            v = rng.choice([0, None, -5]) if rng.random() < 0.04 else int(vol)
            if rng.random() < 0.02:
                c = rng.choice([None, -1.0, float("nan")])
            hi, lo = (c * 1.01, c * 0.99) if c and c > 0 else (px * 1.01, px * 0.99)
            rows.append((next(i), tk, day, c, hi, lo, c, v))
    for tk_start in (100, 300):  # stuck closes, also across shards
        for k in range(tk_start, tk_start + rng.choice([5, 6, 9])):
            r = list(rows[k])
            r[3:7] = [77.0] * 4
            r[7] = 1000 + k
            rows[k] = tuple(r)
    df = frame(spark, [quote(r[0], ticker=r[1], day=r[2], volume=r[7], open=r[3], high=r[4], low=r[5], close=r[6]) for r in rows])
    got = {r["row_id"]: r["kind"] for r in anomalies.flag_readings(df).collect()}
    assert got == brute_flags(rows)
    assert {"spike", "impossible"} <= set(got.values())


def test_kalman_withholds_and_locks_again():
    y = np.array([0, 0.01, 0, 5, 0.01, 0, 3, 3.01, 3, 3.01, 3, 3.01, 9, 3.0])
    flags, score, own = anomalies.kalman(y, *anomalies.noise(0.01, 0.01))
    assert flags.nonzero()[0].tolist() == [3, 6, 7, 8, 9, 12]
    assert (np.abs(score[flags]) > anomalies.INNOVATION_LIMIT).all() and np.allclose(own[1:], np.diff(y))
    assert not anomalies.kalman(np.zeros(9), 0.0, 0.0)[0].any()
    q, r = anomalies.noise(1.0, 1.2)
    assert np.isclose(q + 2 * r, 1.4826**2) and np.isclose(2 * q + 2 * r, (1.4826 * 1.2) ** 2)


def test_the_filter_proposes_all_spikes_and_few_readings():
    """Against the neighbour test on every reading, over levels that wander, noise around a level, and jumps."""
    rng, found, examined, readings = np.random.default_rng(3), 0, 0, 0
    for k in range(300):
        n = 200
        y = np.cumsum(rng.standard_t(4, n) * rng.choice([0, 0.01])) + rng.normal(0, 0.02, n) * rng.choice([0, 1]) + np.where(np.arange(n) > 90, rng.choice([0, 2]), 0)
        for at in rng.integers(2, n - 5, 4):
            y[at : at + rng.integers(1, 5)] += rng.choice([-1, 1]) * rng.uniform(0.2, 2)
        usual = [float(np.median(np.abs(y[g:] - y[:-g]))) for g in (1, 2)]
        x = np.exp(y)
        r = {"x": x, "mpos": np.arange(n), "live": np.ones(n, bool)}
        kinds, _, starts = anomalies.judge_series(r, "high", tuple(usual))
        assert ((kinds == 1) == anomalies.spikes_at(np.log(x), usual[0], np.arange(n))).all()
        found, readings = found + int((kinds == 1).sum()), readings + n
        examined += starts if usual[0] else 0
    assert found > 500 and examined < 0.12 * readings


def test_no_flags_without_rows(spark):
    assert anomalies.flag_readings(frame(spark, [])).count() == 0


# -- late events ------------------------------------------------------------------------------------------------


def test_late_and_expired(spark, tmp_path):
    e = dt.datetime(2024, 1, 1, 23)
    h = lambda n: e + dt.timedelta(hours=n)
    rows = [quote(1, event=e, ingest=h(0.5)), quote(2, event=e, ingest=h(2)), quote(3, event=e, ingest=h(168)), quote(4, event=e, ingest=h(168.001)), quote(5, event=None), quote(6, event=e, ingest=None), quote(7, event=e, ingest=h(-30))]
    for days in (0, 3, 30):
        got = {r["row_id"]: r["status"] for r in late.late_rows(frame(spark, rows), f"file://{tmp_path}/late{days}", days).collect()}
        assert got == {2: "late", 3: "late", 4: "expired"}
    daily = late.daily_as_of(frame(spark, rows)).orderBy("as_of_date").collect()
    assert [(r["messages"], r["late_messages"], r["is_final"]) for r in daily] == [(2, 0, False), (3, 1, False), (4, 2, True)]
    store = late.feed(frame(spark, rows), f"file://{tmp_path}/report")
    assert late.expired_report(store.apart("expired")).first()["dropped"] == 1
    assert late.daily_as_of(frame(spark, [])).count() == 0 and late.late_rows(frame(spark, []), f"file://{tmp_path}/none").count() == 0


def test_state_is_upserted_emitted_and_closed(spark, tmp_path):
    e = dt.datetime(2024, 1, 15, 12)
    day = dt.timedelta(days=1)
    store = late.PeriodStore(spark, f"file://{tmp_path}/p")
    first = store.deliver(frame(spark, [quote(1, event=e, ingest=e, volume=5), quote(2, ticker="XY", event=e, ingest=e)]), tag="1")
    assert sorted((r["ticker"], r["messages"]) for r in first.collect()) == [("AB", 1), ("XY", 1)]
    again = store.deliver(frame(spark, [quote(3, event=e, ingest=e + 2 * day, volume=7), quote(4, event=e, ingest=e + 9 * day)]), tag="2")
    assert [(r["ticker"], r["as_of_date"].day, r["messages"], r["volume"], r["is_final"]) for r in again.collect()] == [("AB", 17, 2, 12, True)]
    version = store.table.manifest()["version"]
    store.deliver(frame(spark, [quote(3, event=e, ingest=e + 2 * day, volume=7)]), tag="2")  # tried again
    assert store.table.manifest()["version"] == version
    store.deliver(frame(spark, [quote(5, event=e + 40 * day, ingest=e + 40 * day)]), tag="3")
    m = store.table.manifest()["metrics"]
    assert (m["openMonths"], m["closedMonths"], m["hitMonths"]) == (1, 1, 1)
    behind = store.deliver(frame(spark, [quote(6, event=e, ingest=e + day, volume=1)]), tag="4")  # out of order: days after it change too
    assert [(r["as_of_date"].day, r["messages"], r["volume"]) for r in behind.orderBy("as_of_date").collect()] == [(16, 2, 6), (17, 3, 13)]
    assert {r["row_id"]: r["status"] for r in store.apart().collect()} == {3: "late", 4: "expired", 6: "late"}


def test_stream_of_redelivered_messages_equals_batch(spark, tmp_path):
    from tickforge.streaming.periods import replay, run_periods

    rng = random.Random(5)
    t = dt.datetime(2024, 1, 1)
    rows = [quote(i, ticker=rng.choice(["A", "b "]), close=rng.random(), event=(e := t + dt.timedelta(hours=rng.randint(0, 90))), ingest=e + dt.timedelta(hours=rng.choice([0, 1, 30, 200]))) for i in range(40)]
    copies = [r[:0] + (100 + i, r[1].strip().lower(), *r[2:11], r[11] + dt.timedelta(hours=rng.choice([0, 1, 50, 190])), "again") for i, r in enumerate(rng.sample(rows, 25))]
    df = frame(spark, rows + copies)
    store = replay(df, f"file://{tmp_path}/out")
    cols = ["ticker", "period", "messages", "late_messages", "volume", "high", "low", "close"]
    kept = redelivery.keep_first(df)
    want = late.daily_as_of(kept).where("is_final").select(cols)
    assert sorted(map(tuple, store.current().select(cols).collect())) == sorted(map(tuple, want.collect()))
    assert sorted(r[0] for r in store.apart("expired").select("row_id").collect()) == sorted(r[0] for r in late.routed(kept).where("status = 'expired'").select("row_id").collect())
    assert store.table.manifest()["metrics"]["tag"] == "2"
    run_periods(spark, f"file://{tmp_path}/out/arrivals", f"file://{tmp_path}/out", df.schema)  # nothing new
    assert store.table.manifest()["metrics"]["tag"] == "2"


# -- rolling totals ---------------------------------------------------------------------------------------------


def brute_totals(days, w):
    """days: {ticker: {day: (close, volume)}}"""
    out = {}
    for tk, q in days.items():
        for d in range(min(q), max(q) + 1):
            got = [q[x] for x in range(d - w + 1, d + 1) if x in q]
            c, v = [x[0] for x in got if x[0] is not None], [x[1] for x in got if x[1] is not None]
            out[tk, d] = (math.fsum(c) if c else None, len(c), sum(v) if v else None, len(v))
    return out


def rolled(df, w):
    epoch = (DAY - dt.date(1970, 1, 1)).days
    return {(r["ticker"], (r["day"] - dt.date(1970, 1, 1)).days - epoch): (r[f"total_close_{w}d"], r[f"n_close_{w}d"], r[f"total_volume_{w}d"], r[f"n_volume_{w}d"]) for r in df.collect()}


def test_rolling_totals_equal_brute_force_and_take_corrections(spark):
    rng = random.Random(6)
    days = {tk: {d: (rng.choice([None, rng.random() * 100, rng.random() * 1e-5]), rng.choice([None, rng.randint(0, 10**6)])) for d in rng.sample(range(span), n)} for tk, span, n in (("AA", 700, 300), ("BB", 40, 3), (None, 300, 150))}
    days["ONE"] = {5: (1.0, 1)}
    make = lambda ds: frame(spark, [quote(i, ticker=tk, day=d, close=c, volume=v) for i, (tk, d, c, v) in enumerate((tk, d, c, v) for tk, q in ds.items() for d, (c, v) in q.items())])
    trees = rolling.build_trees(rolling.day_quotes(make(days)))
    out = rolling.trailing(trees)
    for w in (7, 30):
        assert rolled(out, w) == brute_totals(days, w)
    fix = {"AA": {3: (9.5, 4), 699: (1.25, 2)}, "NEW": {1: (2.0, 2)}}
    corrected = {tk: days.get(tk, {}) | fix.get(tk, {}) for tk in {*days, *fix}}
    again = rolling.trailing(rolling.apply_corrections(trees, rolling.day_quotes(make(fix))))
    assert rolled(again, 30) == brute_totals(corrected, 30)
    assert rolling.rolling_totals(frame(spark, [])).count() == 0


def test_small_prices_and_long_gaps(spark):
    rows = [quote(1, day=0, close=2e-5), quote(2, day=1, close=1e-5), quote(3, day=600, close=float("inf")), quote(4, day=602, close=3.0)]
    out = {(r["day"] - DAY).days: r for r in rolling.rolling_totals(frame(spark, rows)).collect()}
    assert sorted(out) == list(range(603))
    assert (out[1]["total_close_7d"], out[1]["avg_close_7d"], out[8]["total_close_30d"], out[40]["total_close_30d"]) == (2e-5 + 1e-5, (2e-5 + 1e-5) / 2, 2e-5 + 1e-5, None)
    assert out[602]["total_close_7d"] == float("inf") and out[500]["n_close_30d"] == 0


def test_day_quote_prefers_the_latest_event(spark):
    t = dt.datetime(2024, 1, 1, 20)
    rows = [quote(1, close=1.0, event=t), quote(2, close=2.0, event=t + dt.timedelta(hours=1)), quote(3, close=3.0, event=None), quote(4, day=None, close=9.0)]
    assert [r["close"] for r in rolling.day_quotes(frame(spark, rows)).collect()] == [2.0]
