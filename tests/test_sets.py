"""Searches of sets of queries: whole and exact, and neither side is copied to disk once for every block of the other."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tickforge.operators import retrieval, sets

WORDS = [f"w{i}" for i in range(60)] + ["the", "of", "Zinc", "año", "x9"]


def texts(n, seed=3):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, len(WORDS) + 1)
    out = [" ".join(rng.choice(WORDS, rng.integers(3, 40), p=p / p.sum())) + " the." for _ in range(n)]
    return [(i, t) for i, t in enumerate(out)] + [(n, None), (n + 1, ""), (n + 2, "??"), (n + 3, out[5]), (n + 4, out[5])]


def brute(docs, asked, k):
    bags = {i: Counter(re.findall("[a-z0-9]+", (t or "").lower())) for i, t in docs}
    n, avgdl = len(docs), sum(sum(b.values()) for b in bags.values()) / len(docs)
    df = Counter(w for b in bags.values() for w in b)
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    out = {}
    for q, t in asked:
        ask = Counter(re.findall("[a-z0-9]+", (t or "").lower()))
        score = {i: sum(c * (low if idf[w] < 0 else idf[w]) * b[w] * 2.5 / (b[w] + 1.5 * (0.25 + 0.75 * sum(b.values()) / avgdl)) for w, c in ask.items() if w in b) for i, b in bags.items()}
        ordered = sorted((-round(s, 6), i) for i, s in score.items() if round(s, 6) > 0)[:k]
        if ordered:
            out[q] = [(i, pytest.approx(-s, abs=2e-6)) for s, i in ordered]
    return out


@pytest.mark.parametrize("frequent", [0.001, 0.1, 2.0])  # all by products, some, none
def test_a_set_of_questions_finds_what_one_by_one_finds(spark, monkeypatch, frequent):
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 150)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "FILE_BLOCKS", 2)
    monkeypatch.setattr(sets, "FREQUENT", frequent)
    rows = texts(400)
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(2)
    asked = [r for r in rows if r[0] % 25 == 0] + [(1000, "Zinc, zinc"), (1001, "unknown"), (1002, None)]
    got = {}
    hits = retrieval.sparse_search_set(docs, spark.createDataFrame(asked, "query_id BIGINT, question STRING"), 7)
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert got == brute(rows, asked, 7)


def test_blocks_in_ranges_with_negative_weights_are_exact(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sets, "RANGE", 64)
    rows = texts(300, 5)
    table = pa.table({"id": [str(1000 + i) for i, _ in rows], "t": pa.array([(t or "").lower() for _, t in rows])})
    rng = np.random.default_rng(1)
    asked = [(q, w, float(x)) for q in range(9) for w, x in zip(["the", "w1", "w7", "w20", "w40", "x9"], rng.normal(size=6))]
    block = sets.TermBlock(table, 20.0, 5, 4)
    got = {}
    for t in block(pa.table({"query_id": [a[0] for a in asked], "term": [a[1] for a in asked], "w": [a[2] for a in asked]})):
        for q, i, s in zip(*(t[c].to_pylist() for c in ("query_id", "id", "score"))):
            got.setdefault(q, []).append((i, s))
    for q in range(9):
        score = []
        for i, t in rows:
            b = Counter(re.findall("[a-z0-9]+", (t or "").lower()))
            s = sum(x * b[w] * 2.5 / (b[w] + 1.5 * (0.25 + 0.75 * sum(b.values()) / 20.0)) for a, w, x in asked if a == q and w in b)
            score.append((-round(s, 6), str(1000 + i)))
        assert got.get(q, []) == [(i, pytest.approx(-s, abs=2e-6)) for s, i in sorted(score)[:5] if s < 0]


def shuffled(df):
    """Rows that a query's exchanges write, from the metrics of its plan once it has run."""
    df.write.format("noop").mode("overwrite").save()
    status = df.sparkSession._jsparkSession.sharedState().statusStore()
    runs = status.executionsList()
    last = runs.apply(runs.size() - 1)
    values = status.executionMetrics(last.executionId())
    found = [last.metrics().apply(i) for i in range(last.metrics().size())]
    found = {m.accumulatorId() for m in found if m.name() == "shuffle records written" and values.contains(m.accumulatorId())}
    return sum(int(re.sub(r"\D", "", values.apply(a)) or 0) for a in found)


def test_neither_side_is_copied_for_the_blocks_of_the_other(spark, monkeypatch):
    """Before, each block of rows was shuffled once for every block of queries and each block of queries for every block of rows."""
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 100)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    rows = texts(400)
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
    asked = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id").withColumnRenamed("text", "question")
    # at most k hits a query and block of rows
    assert shuffled(retrieval.sparse_search_set(docs, asked, 3)) <= 8 * 21 * 3 + len(rows)
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(400)], "vec_id BIGINT, embedding ARRAY<DOUBLE>").repartition(4)
    some = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    assert shuffled(retrieval.dense_search_set(vectors, some, 3)) <= 8 * 20 * 3 + 400


def test_reranking_moves_lists_and_not_texts(spark, monkeypatch):
    """Before, all texts met the hits in one shuffle and went on with them to the questions in another."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame(texts(400), "id BIGINT, text STRING").coalesce(2).persist()
        docs.count()
        fused = spark.createDataFrame([(q, q * 50 + i, i + 1) for q in range(3) for i in range(4)] + [(3, 400, 1), (3, 9999, 2)], "query_id BIGINT, id BIGINT, final_rank BIGINT")
        asked = spark.createDataFrame([(0, "the of Zinc"), (1, "w1 w2"), (3, "the")], "query_id BIGINT, question STRING")
        best = retrieval.rerank_set(fused, docs, asked, 4)
        assert shuffled(best) < 60
        got = {(r["query_id"], r["id"]): r["rerank_score"] for r in best.collect()}
        bags = {i: set(re.findall("[a-z0-9]+", (t or "").lower())) for i, t in texts(400)}
        ask = {0: {"the", "of", "zinc"}, 1: {"w1", "w2"}, 2: set(), 3: {"the"}}
        assert got == {(q, i): pytest.approx(len(ask[q] & bags[i]) / max(1, len(ask[q])), abs=1e-6) for q, i in [(q, q * 50 + i) for q in range(3) for i in range(4)] + [(3, 400)]}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["rrf_set_fused", "rrf_set_small_k"])
def test_registered_fusions_move_hits_only(spark, monkeypatch, tmp_path, name):
    import __spark_entry__ as e

    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 100)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    spark.createDataFrame(texts(1000), "doc_id BIGINT, text STRING").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i % 7), float(i % 11), 1.0]) for i in range(1000)], "vec_id BIGINT, embedding ARRAY<DOUBLE>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    # 21 questions and 20 vectors against at most 13 blocks each, 2 x 1,005 rows spread from one file, and the fused lists
    assert shuffled(e.queries()[name](spark, str(tmp_path))) <= 13 * 30 * 41 + 2 * 1005 + 2 * 30 * 41
