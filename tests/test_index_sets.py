"""The stored index is asked with sets of questions: hits are moved, not pairs of questions and postings."""

import pytest
from pyspark.sql import functions as F
from test_sets import shuffled

from tickforge.operators import answering


def test_an_index_search_moves_hits_and_not_pairs(spark, tmp_path):
    """Before, every posting of an asked term met every question that asks it, in one shuffle."""
    body = lambda i: f"The group {i} sells turbines {i % 9} and spare parts {i % 5} to towns. " * 4
    cols = "doc_id BIGINT, text STRING, source_file STRING, item STRING, ticker STRING, company STRING, form_type STRING, fiscal_year INT, section_title STRING"
    sections = spark.createDataFrame([(i, body(i), f"{i}.htm", "Item 1", "AC", "Acme", "10-K", 2020, "Business") for i in range(300)], cols)
    index = answering.ChunkIndex(spark, f"file://{tmp_path}/index")
    assert index.build(sections)["embedded"] == 300
    asked = sections.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    assert shuffled(index.sparse(asked, 3)) <= 8 * 60 * 3 + 300
    first = {r["query_id"]: r["id"] for r in index.sparse(asked, 3).where("rank = 1").collect()}
    ids = {r["doc_id"]: r["chunk_id"] for r in index.table.read().select("doc_id", "chunk_id").collect()}
    assert len(first) == 60 and all(first[q] == ids[q] for q in first)


def test_vectors_row_by_row(spark):
    rows = [(1, "wind power wind"), (2, None), (3, "!"), (4, "court")]
    got = {r["id"]: r["embedding"] for r in answering.hashed(spark.createDataFrame(rows, "id BIGINT, text STRING")).collect()}
    assert got[2] is None and got[3] is None and len(got[1]) == 64
    assert sorted(abs(x) for x in got[1] if x) == pytest.approx([1 / 5**0.5, 2 / 5**0.5]) and [abs(x) for x in got[4] if x] == [1.0]
