"""The analytical operators: table layer, contract, gate, retrieval, chunking, sources, lineage, stages."""

import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from tickforge import schemas
from tickforge.operators import contract, expectations, medallion, metrics, retrieval, text
from tickforge.operators.lineage import Recorder, read_events, run_id, summary
from tickforge.operators.tables import CommitConflict, VersionedTable, WriteRefused, merge_frames
from tickforge.runner import Stage, run_stages
from tickforge.sources import filings, quotes

DAY = dt.date(2021, 6, 15)
BAR = "ticker STRING, trade_date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT"


def bars(spark, n=40, tickers=("AA", "BB")):
    rows = [(t, DAY + dt.timedelta(days=i), 10.0 + i, 12.0 + i, 9.0 + i, 11.0 + i, 100 + i) for t in tickers for i in range(n)]
    return spark.createDataFrame(rows, BAR)


@pytest.fixture
def table(spark, tmp_path):
    want = type(schemas.SILVER)([f for f in schemas.SILVER if f.name in ("ticker", "trade_date", "open", "high", "low", "close", "volume")])
    return VersionedTable(spark, f"file://{tmp_path}/t").create(want, partition_by="ticker", constraints=schemas.SILVER_CHECKS)


def test_refused_writes_leave_the_table_alone(spark, table):
    good = bars(spark)
    table.append(good)
    one = good.limit(1)
    bad = [
        one.withColumn("x", F.lit(1)), one.drop("close"), one.withColumn("volume", F.col("volume").cast("string")), one.withColumn("close", F.lit(None).cast("double")),
        one.withColumn("high", F.col("low") / 2), one.withColumn("low", -F.col("low")),
    ]
    for frame in bad:
        with pytest.raises(WriteRefused):
            table.append(frame)
    assert table.versions() == [0, 1] and table.read().count() == 80
    table.append(one)
    assert table.read().count() == 81 and table.read(1).count() == 80  # time travel
    assert [r["operation"] for r in table.history(2).collect()] == ["WRITE", "WRITE"]


def test_a_lost_race_is_a_conflict(spark, table):
    table.append(bars(spark))
    base = table.manifest()
    table.append(bars(spark).limit(1))
    with pytest.raises(CommitConflict):
        table.replace(bars(spark).limit(2), None, "REPLACE", {}, base=base)
    assert table.read().count() == 81


def test_merge_counts_guards_and_is_idempotent(spark, table):
    table.append(bars(spark, 10))
    source = bars(spark, 15, ("BB", "CC")).withColumn("close", F.col("close") + 0.5)
    assert table.merge(source, ["ticker", "trade_date"]) == {"numInserted": 20, "numUpdated": 10, "numKept": 10, "numDeleted": 0}
    first = sorted(map(tuple, table.read().collect()))
    table.merge(source, ["ticker", "trade_date"])
    assert sorted(map(tuple, table.read().collect())) == first
    with pytest.raises(WriteRefused):
        table.merge(source.unionByName(source), ["ticker", "trade_date"])
    merged = merge_frames(bars(spark, 1, ("AA",)), bars(spark, 1, ("AA",)).withColumn("volume", F.lit(1).cast("bigint")), ["ticker"], lambda s, t: s("volume") >= t("volume"))
    assert merged.first()["__action"] == "keep"


def test_layers_end_to_end(spark, tmp_path):
    lines = contract.payloads(bars(spark)).select(F.col("raw_payload").alias("value"), F.lit("f").alias("source_file"))
    lines = lines.unionByName(spark.createDataFrame([(" ", "f"), ("{", "f")], "value STRING, source_file STRING"))
    got = medallion.run_silver(spark, medallion.bronze_lines(lines, "b"), f"file://{tmp_path}/silver")
    assert (got["parsed"], got["unparseable"], got["numInserted"]) == (81, 1, 80)
    silver = VersionedTable(spark, f"file://{tmp_path}/silver").read()
    assert medallion.run_gold(spark, silver, f"file://{tmp_path}/gold")["numInserted"] == 2
    assert medallion.run_gold(spark, silver.where(F.col("trade_date") < F.lit(DAY + dt.timedelta(days=9))), f"file://{tmp_path}/gold")["numKept"] == 2


def test_every_fault_is_caught_with_its_reason(spark):
    b = bars(spark, 30)
    for fault, reason in contract.FAULTS.items():
        judged = contract.verdicts(contract.payloads(b.withColumn("fault", F.lit(fault))))
        assert [r[0] for r in judged.select("reason").distinct().collect()] == [reason], fault
    assert contract.verdicts(contract.payloads(b)).where("reason IS NOT NULL").count() == 0
    assert contract.verdicts(contract.payloads(b.limit(0))).count() == 0


def test_gate(spark):
    suite = expectations.quote_suite(("AA", "BB"))
    assert len(suite) == 20
    assert expectations.run_gate(bars(spark), suite)["success"]
    seen = []
    with pytest.raises(expectations.GateFailure) as e:
        expectations.run_gate(expectations.taint(bars(spark)), suite, seen.append)
    failed = {f["label"]: f["unexpected_count"] for f in e.value.report["failed"]}
    assert seen and seen[0] is e.value.report and e.value.report["successful"] == 13
    assert failed["not_null:close"] == 1 and failed["pair_at_least:high,low"] == 3 and failed["compound_unique:ticker,trade_date"] == 9
    assert not expectations.run_gate(bars(spark).limit(0), suite, fail=False)["success"]


def test_metrics_of_the_last_session(spark):
    m = {r["ticker"]: r for r in metrics.ticker_metrics(bars(spark, 300)).collect()}["AA"]
    assert m["as_of_date"] == DAY + dt.timedelta(days=299) and m["ma_7"] == 307.0 and m["ma_30_trend"] == "RISING"
    assert m["high_52w"] == 311.0 and m["low_52w"] == 9.0 + 48 and m["sessions_observed"] == 300
    one = metrics.ticker_metrics(bars(spark, 1)).first()
    assert one["volatility_30d_annualised"] is None and one["ma_30_trend"] is None and one["ma_30"] == 11.0


def ranking(spark, ids, start=1):
    return spark.createDataFrame([(i, start + n, 1.0 - n / 100) for n, i in enumerate(ids)] or [], "id STRING, rank BIGINT, score DOUBLE")


def test_rank_fusion(spark):
    out = retrieval.fuse({"dense": ranking(spark, "AB"), "sparse": ranking(spark, "CB")}).orderBy("final_rank").collect()
    assert [r["id"] for r in out] == ["B", "A", "C"] and [r["final_rank"] for r in out] == [1, 2, 3]
    assert out[0]["retrievers"] == ["dense", "sparse"] and abs(out[0]["rrf_score"] - 2 / 62) < 1e-9 and out[0]["sparse_rank"] == 2
    carried = retrieval.fuse({"sparse": ranking(spark, "Z", start=9)}).first()
    assert abs(carried["rrf_score"] - 1 / 61) < 1e-9 and carried["sparse_rank"] == 9  # the position counts, not the rank
    assert retrieval.fuse({"dense": ranking(spark, ""), "sparse": ranking(spark, "")}).count() == 0


def test_bm25_equals_plain_python(spark):
    import math
    import re

    docs = ["the cat sat on the mat", "the dog sat", "a cat and a dog and a cat", "", None, "the the the"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id BIGINT, text STRING")
    toks = [re.findall("[a-z0-9]+", d or "") for d in docs]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    freq = {w: sum(w in t for t in toks) for t in toks for w in t}
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in freq.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    want = {}
    for i, t in enumerate(toks):
        s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in ("the", "cat", "cat", "zebra") if w in t)
        if any(w in t for w in ("the", "cat")):
            want[i] = round(s, 6)
    got = {r["id"]: r["score"] for r in retrieval.bm25_scores(df, "The cat, cat zebra?").collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_citations_sync_and_answers(spark):
    a = spark.createDataFrame([(1, "x [S2] y [S2][S9]", 3), (2, None, 1), (3, "[S1]", None)], "answer_id BIGINT, answer STRING, n INT")
    got = sorted((r["id"], r["marker"], r["first_pos"], r["resolved"]) for r in retrieval.citations(a, "answer_id", "answer", "n").collect())
    assert got == [(1, "[S2]", 0, True), (1, "[S9]", 2, False), (3, "[S1]", 0, False)]
    ids = lambda s: spark.createDataFrame([(c,) for c in s], "chunk_id STRING")
    assert sorted(map(tuple, retrieval.index_sync(ids("abb"), ids("bc")).collect())) == [("a", "add"), ("b", "keep"), ("c", "delete")]
    v = retrieval.hashing_vectors(spark.createDataFrame([(1, "wind power"), (2, "court")], "d BIGINT, t STRING"), "d", "t")
    q = v.where("vec_id = 1").first()["embedding"]
    assert retrieval.dense_search(v, list(q), 1).first()["id"] == 1
    p = spark.createDataFrame([(2, "B is so. More."), (1, "A was. C")], "final_rank BIGINT, text STRING")
    assert retrieval.extractive_answer(spark, "q", p).first()["answer"] == "A was. [S1] B is so. [S2]"
    assert retrieval.extractive_answer(spark, "q", p.limit(0)).first()["refused"]


def test_chunks_cover_the_text(spark):
    hyp = pytest.importorskip("hypothesis")

    @hyp.given(hyp.strategies.text("ab .!?\n", max_size=400), hyp.strategies.integers(2, 60), hyp.strategies.integers(0, 80))
    @hyp.settings(deadline=None, max_examples=200)
    def covers(t, size, overlap):
        spans = text.cut(t, size, overlap)
        assert (spans[0][0], spans[-1][1]) == (0, len(t)) if t else spans == []
        assert all(a < b and b - a <= size for a, b in spans)
        assert all(x[0] < y[0] <= x[1] for x, y in zip(spans, spans[1:]))

    covers()
    assert text.cut("x" * 10 + "\n\n" + "y" * 10, 16, 4) == [(0, 12), (8, 22)]
    docs = spark.createDataFrame([(1, "Word one. " * 400, "f.htm", "Item 1"), (2, "None.", "f.htm", "Item 3"), (3, None, "g", None)], "doc_id BIGINT, text STRING, source_file STRING, item STRING")
    a, b = (sorted(r["chunk_id"] for r in text.chunks(docs).collect()) for _ in range(2))
    assert a == b and len(set(a)) == len(a) > 1 and all(len(c) == 16 for c in a)


def test_markup_and_sections():
    body = "Item 1. Business " + "We sell. " * 80
    raw = f"<html><script>bad()</script><body><p>Item 1. Business\nItem 1A. Risk Factors</p><p>{body}</p><p>Item 1A. Risk Factors {'Risky. ' * 90}</p><p>Item 2. Properties x</p>&amp; “q”</body></html>"
    plain = text.plain_text(raw)
    assert "bad()" not in plain and '& "q"' in plain
    assert [(i, b[:17]) for i, _, b in text.sections_of(plain)] == [("Item 1", "Item 1. Business "), ("Item 1A", "Item 1A. Risk Fac")]
    assert text.plain_text(None) is None and text.sections_of(None) == []


def test_quote_files(spark, tmp_path):
    wide = tmp_path / "wide"
    wide.mkdir()
    (wide / "q.csv").write_text("Date,Symbol,Open,High,Low,Close,Adj Close,Volume\n2021-06-15, aapl,1,2,0.5,1.5,1.4,10\n06/16/2021,MSFT,x,,,,1,5\nnever,MSFT,1,1,1,1,1,1\n2021/06/14,MSFT,1,1,1,n/a,1,7.0\n")
    (wide / "other.csv").write_text("a,b\n1,2\n")
    rows = [(r["ticker"], str(r["trade_date"]), r["close"], r["volume"]) for r in quotes.load_quotes(spark, str(wide)).collect()]
    assert rows == [("MSFT", "2021-06-14", None, 7), ("AAPL", "2021-06-15", 1.5, 10)]
    per = tmp_path / "per"
    per.mkdir()
    (per / "aapl.csv").write_text("Price,Close,High,Low,Open,Volume\nTicker,AAPL,AAPL,AAPL,AAPL,AAPL\nDate,,,,,\n2021-06-15,1.5,2,0.5,1,10\n")
    r = quotes.load_quotes(spark, str(per)).first()
    assert (r["ticker"], r["close"], r["high"], r["low"], r["open"], r["volume"]) == ("AAPL", 1.5, 2.0, 0.5, 1.0, 10)
    odd = tmp_path / "odd"
    odd.mkdir()
    (odd / "other.csv").write_text("a,b\n1,2\n")
    with pytest.raises(FileNotFoundError):
        quotes.load_quotes(spark, str(odd))


def test_filings(spark, tmp_path):
    side = tmp_path / "side"
    side.mkdir()
    (side / "a.json").write_text(json.dumps({"filename": "a.htm", "company": "Acme Labs", "cik": "1", "filing_type": "10-k", "period_of_report": "2021-12-31", "item_1": "x" * 600, "item_3": "short"}))
    (side / "b.json").write_text(json.dumps({"filing_type": "8-K", "item_1": "x" * 600}))
    (side / "c.json").write_text("[1")
    rows = filings.read_side_files(spark, str(side)).collect()
    assert [(r["source_file"], r["form_type"], r["fiscal_year"], r["item"]) for r in rows] == [("a.htm", "10-K", "2021", "Item 1")]
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "0001_2020.txt").write_text("CONFORMED SUBMISSION TYPE: 10-K\nCOMPANY CONFORMED NAME: Beta plc\n\nItem 1. Business " + "We sell. " * 80)
    got = filings.read_submissions(spark, str(raw), 0).first()
    assert (got["company"], got["fiscal_year"], got["cik"], got["item"]) == ("Beta plc", "2020", "0001", "Item 1")
    both = filings.read_side_files(spark, str(side)).unionByName(filings.read_submissions(spark, str(raw), 0))
    assert [r["company"] for r in filings.prioritised(both, ("beta",), 1).collect()] == ["Beta plc"]


def test_run_ids_lineage_and_stages(spark, tmp_path):
    u = str(uuid.uuid4())
    assert run_id(u) == u and run_id("manual__2024") == run_id("manual__2024") and uuid.UUID(run_id(None))
    rec = Recorder(f"{tmp_path}/l.jsonl", "manual__2024")

    def fail():
        raise RuntimeError("no")

    state = run_stages([Stage("c", lambda: None, ("b",)), Stage("a", lambda: {"n": 1}), Stage("b", fail, ("a",)), Stage("d", lambda: None, ("a",))], rec)
    assert state == {"a": "success", "b": "failed", "c": "upstream_failed", "d": "success"}
    got = {r["job"]: (r["START"], r["COMPLETE"], r["FAIL"]) for r in summary(read_events(spark, f"{tmp_path}/l.jsonl")).collect()}
    assert got == {"a": (1, 1, 0), "b": (1, 0, 1), "d": (1, 1, 0)}
    with pytest.raises(ValueError):
        run_stages([Stage("x", lambda: None, ("y",))])


def test_entry_lists_queries_and_sql():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q)
    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p6_found", "p7_rolling_totals"} <= set(q)


# -- index and answers ------------------------------------------------------------------------------------------


def filings_frame(spark, rows):
    cols = "doc_id BIGINT, text STRING, source_file STRING, item STRING, ticker STRING, company STRING, form_type STRING, fiscal_year INT, section_title STRING"
    return spark.createDataFrame([(i, t, f"{i}.htm", "Item 1", "AC", "Acme", "10-K", 2020, "Business") for i, t in rows], cols)


def test_index_is_synced_and_answers_are_cited(spark, tmp_path):
    from tickforge.operators import answering

    texts = {1: "Wind turbines raise the costs of spare parts. " * 6, 2: "Jury verdicts may lead to large damages for the group. " * 6, 3: "Season tickets sell slowly in smaller towns this year. " * 6}
    index = answering.ChunkIndex(spark, f"file://{tmp_path}/index")
    assert index.build(filings_frame(spark, texts.items())) == {"embedded": 3, "reused": 0, "removed": 0}
    assert index.build(filings_frame(spark, texts.items())) == {"embedded": 0, "reused": 3, "removed": 0}
    texts[4] = "Peak load strains the power grid every winter evening. " * 6
    del texts[3]
    assert index.build(filings_frame(spark, texts.items())) == {"embedded": 1, "reused": 2, "removed": 1}
    asked = spark.createDataFrame([(1, "Which jury verdicts?"), (2, "season tickets"), (3, "???"), (4, None)], "query_id BIGINT, question STRING")
    sparse = [(r["query_id"], r["rank"]) for r in index.sparse(asked).collect()]
    assert sparse == [(1, 1)]  # the deleted chunk's postings are gone
    answers, audit = answering.answer_questions(index, asked)
    got = {r["query_id"]: r for r in answers.collect()}
    assert got[1]["answer"].startswith("Jury verdicts may lead") and "[S1]" in got[1]["answer"] and not got[1]["refused"] and got[1]["warnings"] == []
    assert got[4]["refused"] and got[4]["sources_supplied"] == 0
    rows = {r["query_id"]: r for r in audit.collect()}
    assert rows[1]["unresolved"] == 0 and rows[1]["cited"] == got[1]["sources_supplied"] > 0 and rows[1]["found_by_both"] >= 1
    total = answering.demo_summary(answers, audit).first()
    assert (total["questions"], total["refused"] + total["answered"]) == (4, 4)
    with pytest.raises(ValueError):
        index.build(filings_frame(spark, [(1, "short")]))


def test_plug_ins_are_asked_and_may_be_missing(spark, tmp_path):
    from tickforge.operators import answering

    sections = filings_frame(spark, [(1, "Wind turbines raise the costs of spare parts. " * 6)])
    odd = answering.Plugins(generate=lambda p: p.withColumn("answer", F.lit("It rose [S1][S7][S99999999999].")), score=lambda p: p.withColumn("rerank_score", F.lit(None).cast("double")))
    index = answering.ChunkIndex(spark, f"file://{tmp_path}/a", odd)
    index.build(sections)
    answers, audit = answering.answer_questions(index, spark.createDataFrame([(1, "wind costs")], "query_id BIGINT, question STRING"))
    assert answers.first()["warnings"] == ["The answer cites a source that was not supplied."]
    assert (audit.first()["cited"], audit.first()["unresolved"]) == (3, 2)
    with pytest.raises(answering.PluginUnavailable):
        answering.ChunkIndex(spark, f"file://{tmp_path}/b", answering.Plugins(ready=lambda: "no model is served")).build(sections)


def test_inverted_lists_find_what_the_whole_search_finds(spark):
    import numpy as np

    from tickforge.operators import vectors

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + rng.normal(size=16) * 0.3).tolist()) for i in range(1000)] + [(2000, None), (2001, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    asked = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    index = vectors.VectorIndex(df, probes=1).calibrated(asked, 0.95, k=10)
    assert index.recall(asked, 10) >= 0.95 and index.probes < index.lists
    assert index.rows.count() == 1001
    whole = {tuple(r) for r in retrieval.dense_search_set(df, asked, 10).select("query_id", "id", "rank").collect()}
    assert {tuple(r) for r in index.search(asked, 10, probes=index.lists).select("query_id", "id", "rank").collect()} == whole
    assert vectors.VectorIndex(df.limit(0)).search(asked).count() == 0


def test_archives_and_raw_filings(spark, tmp_path):
    import zipfile

    (tmp_path / "raw").mkdir()
    with zipfile.ZipFile(tmp_path / "raw" / "q.zip", "w") as z:
        z.writestr("inner/q.csv", "\ufeffDate,Symbol,Open,High,Low,Close,Volume\n2022-03-09,QX,1,2,0.5,1.5,10\n")
    for _ in range(2):  # the second time nothing is unpacked again
        assert [r["ticker"] for r in quotes.load_quotes(spark, str(tmp_path / "raw")).collect()] == ["QX"]
    subs = tmp_path / "subs"
    subs.mkdir()
    for name, company, n in (("a.txt", "Small Co", 80), ("b.txt", "Large Co", 900), ("c.txt", "Huge Co", 1500)):
        (subs / name).write_text(f"CONFORMED SUBMISSION TYPE: 10-K\nCOMPANY CONFORMED NAME: {company}\n\nItem 1. Business " + "We sell. " * n)
    got = filings.load_filings(spark, None, str(subs), limit=2, min_bytes=0)
    assert sorted(r["company"] for r in got.select("company").distinct().collect()) == ["Huge Co", "Large Co"]
    with pytest.raises(FileNotFoundError):
        filings.load_filings(spark, None, str(subs), min_bytes=10**9)
