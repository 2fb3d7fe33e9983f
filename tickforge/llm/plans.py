"""Queries of the text problems. SQL can't express them; the tests hold them against brute force instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm import encoding, mixture, pairs, subjects
from tickforge.workspace import read


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.one_defect(read(spark, d, "grounded_answers"))


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    """All defects of a pair whose posteriors reach their cutoffs."""
    return pairs.pair_labels(read(spark, d, "grounded_answers")).where(F.size("defects") > 0)


def p5_rules(spark: SparkSession, d: str) -> DataFrame:
    """What the label model decides, against any vote and a majority of votes."""
    return pairs.rules_compared(read(spark, d, "grounded_answers"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_texts(read(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    mixed, _ = mixture.mix(read(spark, d, "documents").select("doc_id", "source", "text"), read(spark, d, "mix_targets"))
    return mixed


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    _, shares = mixture.mix(read(spark, d, "documents").select("doc_id", "source", "text"), read(spark, d, "mix_targets"))
    return shares


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.propagate(read(spark, d, "documents"), read(spark, d, "subject_areas"), read(spark, d, "subject_labels"))


QUERIES = {f.__name__: f for f in (p5_found, p5_labels, p5_rules, p8_ids, p9_mix, p9_shares, p10_found)}
SQL: dict[str, str] = {}
