"""Cases of the reviews: whole query sets, null groups."""

import datetime as dt
import hashlib

import numpy as np
import pytest

from tickforge.operators import retrieval, rolling


def test_every_query_of_a_set_is_searched(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 40)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    m = np.random.default_rng(5).normal(size=(150, 8)).round(3)
    m[7] = m[50]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(150, None)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = retrieval.dense_search_set(v, v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 5).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(q, int(i), r + 1) for q in (0, 50, 100) for r, i in enumerate(np.lexsort((np.arange(150), -np.round(u @ u[q], 6)))[:5])}
    assert {(r["query_id"], r["id"], r["rank"]) for r in got} == want and (50, 7, 1) in want

    words = np.array(["the", "cat", "dog", "hail", "loss", "server", "cloud", "credit"])
    docs = spark.createDataFrame([(i, " ".join(words[np.argsort(-x)[: 2 + i % 5]])) for i, x in enumerate(m)] + [(150, None), (200, "")], "doc_id BIGINT, text STRING")
    asked = docs.where("doc_id % 50 = 0").selectExpr("doc_id AS query_id", "text AS question")
    sets = {}
    for r in retrieval.sparse_search_set(docs, asked, 5).collect():
        sets.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    assert set(sets) == {0, 50, 100}
    for q in asked.where("length(question) > 0").collect():
        one = [(r["rank"], r["id"], pytest.approx(r["score"], abs=2e-6)) for r in retrieval.sparse_search(docs, q["question"], 5).orderBy("rank").collect()]
        assert sorted(sets[q["query_id"]]) == one


def test_fusion_and_reranking_keep_queries_apart(spark):
    rows = lambda x: spark.createDataFrame(x, "query_id BIGINT, id BIGINT, rank BIGINT, score DOUBLE")
    dense, sparse = rows([(1, 10, 1, 0.9), (1, 11, 2, 0.8), (2, 11, 1, 0.7)]), rows([(1, 11, 1, 3.0), (3, 10, 1, 2.0)])
    fused = retrieval.fuse({"dense": dense, "sparse": sparse}, by=("query_id",))
    assert sorted((r["query_id"], r["id"], r["final_rank"]) for r in fused.collect()) == [(1, 10, 2), (1, 11, 1), (2, 11, 1), (3, 10, 1)]
    texts = spark.createDataFrame([(10, "hail losses"), (11, "cloud")], "id BIGINT, text STRING")
    asked = spark.createDataFrame([(1, "Hail, hail!"), (3, None)], "query_id BIGINT, question STRING")
    best = retrieval.rerank_set(fused, texts, asked, 1)
    assert sorted((r["query_id"], r["id"], r["before"], r["rerank_score"]) for r in best.collect()) == [(1, 10, 2, 1.0), (2, 11, 1, 0.0), (3, 10, 1, 0.0)]
    assert sorted(map(tuple, retrieval.moves(fused, best, 1, ("query_id",)).collect())) == [(1, 10, "promoted"), (1, 11, "demoted")]


def test_the_registered_sets_ask_with_every_fiftieth_row(spark):
    import __spark_entry__ as e

    sf = "/root/testdata/sf0.001"
    ids = lambda t, c: {r[0] for r in spark.read.parquet(f"{sf}/{t}.parquet").where(f"{c} % 50 = 0").select(c).collect()}
    got = {r[0] for r in e.queries()["dense_set_top30"](spark, sf).select("query_id").distinct().collect()}
    assert got == ids("embeddings", "vec_id") and len(got) > 1
    for name in ("dense_set_top30", "bm25_set_top30", "rrf_set_fused", "rrf_set_small_k", "rerank_set_lexical", "rerank_set_moves", "top_list_set_overlap"):
        assert "query_id" in e.oracle_sql()[name]


def test_documents_without_source_or_company_count(spark, tmp_path):
    import __spark_entry__ as e

    rows = [(1, "a", None, None), (2, "bb", "press_wire", "X"), (3, "c", "analyst_note", None), (4, None, None, None), (5, "d", "other", "Y Labs")]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, company STRING").write.parquet(f"{tmp_path}/documents.parquet")
    names = {hashlib.md5(t.encode()).hexdigest(): t for t in ("a", "bb", "c", "d")}
    got = {names[r["chunk_id"]]: r["action"] for r in e.queries()["index_sync_plan_whole"](spark, str(tmp_path)).collect()}
    assert got == {"a": "keep", "bb": "delete", "c": "add", "d": "keep"}
    assert list(map(tuple, e.queries()["filing_priority_whole"](spark, str(tmp_path)).collect())) == [("Y Labs", True, 1, 1), (None, False, 2, 2), ("X", False, 2, 1)]


def test_rolling_totals_as_they_stand(spark):
    closes = [175.15270003503056, 1.00004999, 2.5]
    kept = spark.createDataFrame([(i, "AA", dt.date(2024, 1, 1 + i), None, c, 10) for i, c in enumerate(closes)], "row_id BIGINT, ticker STRING, trade_date DATE, event_ts TIMESTAMP, close DOUBLE, volume BIGINT")
    got = rolling.rolling_totals(kept).orderBy("day").collect()
    assert [r["total_close_7d"] for r in got] == pytest.approx(np.cumsum(closes).tolist(), rel=1e-13)
    assert got[2]["avg_close_30d"] == pytest.approx(sum(closes) / 3, rel=1e-13)
