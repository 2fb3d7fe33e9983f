"""Each text operator on nulls in every column, empty and very long texts, repeated rows, empty tables and extra columns
with names that the operators use themselves."""

import pytest
from pyspark.sql import functions as F

from tickforge.llm import encoding, mixture, pairs, subjects

LONG = "Spending on wind turbines rose sharply in the year. " * 20_000
CLASHES = ["n_tokens", "copy", "shuffle_key", "words", "type", "n", "phrase", "total", "subject", "flag", "votes", "empty", "defect", "h", "id", "ids", "last_word", "word", "final"]


def variants(df):
    return [df, df.limit(0), df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})]


@pytest.fixture
def documents(spark):
    rows = [(1, "a short text", "x", "Acme"), (2, None, "x", None), (3, "", "y", ""), (4, LONG, "y", "Acme"), (5, "é\u0000​🎉", None, "Acme"), (None, "no id", "x", "Acme"), (1, "a short text", "x", "Acme"), (6, ". . .", "z", "(")]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, company STRING")


def test_encoding(documents):
    for df in variants(documents):
        out = encoding.encode_texts(df)
        assert out.count() == df.count() and out.where("doc_id IN (2, 3) AND size(ids) > 0").count() == 0


def test_mixture(spark, documents):
    targets = spark.createDataFrame([("x", 0.5, 3), ("y", 0.5, 1), ("none", 0.0, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    for df in variants(documents):
        mixed, shares = mixture.mix(df, targets)
        assert shares.count() == 3 and mixed.where("source IS NULL OR source = 'z' OR copy > 3").count() == 0


def test_pairs(spark):
    rows = [(1, None, None, None), (2, "What?", None, True), (3, None, "It rose.", False), (4, "", "", None), (5, "Why?", LONG, None), (6, LONG, LONG, None), (5, "Why?", LONG, None), (None, "Why?", "Because costs rose.", None), (7, "Why?", "\u0000​", None)]
    for df in variants(spark.createDataFrame(rows, "answer_id BIGINT, question STRING, answer STRING, refused BOOLEAN")):
        got = [(r["answer_id"], r["defect"]) for r in pairs.one_defect(df).collect()]
        assert not got or {(1, "empty"), (2, "empty"), (4, "empty"), (7, "empty")} <= set(got)
        assert pairs.one_defect(df.drop("refused")).count() == len(got)


def test_subjects(spark, documents):
    areas = spark.createDataFrame([("energy", "about"), ("law", None), (None, None)], "subject STRING, about STRING")
    seeds = spark.createDataFrame([(4, "energy"), (4, "energy"), (99, "law"), (None, "law"), (1, None)], "doc_id BIGINT, subject STRING")
    for df in variants(documents):
        for some in (seeds, seeds.limit(0)):
            got = {tuple(r) for r in subjects.propagate(df, areas.where("subject IS NOT NULL"), some).collect()}
            assert got == ({(4, "energy"), (99, "law")} if some.count() else set())
