"""Filings: JSON side files with prepared sections, and raw submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.operators.text import MIN_SECTION, split_sections, strip_markup

# Indexable items of a side file, header fields of a submission.
ITEMS = {
    "item_1": "Business",
    "item_1A": "Risk Factors",
    "item_3": "Legal Proceedings",
    "item_7": "Management's Discussion and Analysis",
    "item_7A": "Quantitative and Qualitative Disclosures About Market Risk",
}
HEADER = {
    "company": r"COMPANY CONFORMED NAME:\s*([^\r\n]+)",
    "cik": r"CENTRAL INDEX KEY:\s*(\d+)",
    "form_type": r"CONFORMED SUBMISSION TYPE:\s*([^\r\n]+)",
    "period": r"CONFORMED PERIOD OF REPORT:\s*(\d{8})",
    "filed_date": r"FILED AS OF DATE:\s*(\d{8})",
    "ticker": r"TRADING SYMBOL:\s*([^\r\n]+)",
}
HEADER_CHARS, MIN_RAW_BYTES = 8000, 20_000
_SIDE = T.StructType([T.StructField(c, T.StringType()) for c in ("filename", "company", "cik", "filing_type", "filing_date", "period_of_report", *ITEMS)])


def _full(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def read_side_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per section of sufficient length of each annual report."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    j = raw.select("file", F.from_json("value", _SIDE).alias("j")).where(F.col("j").isNotNull()).select("file", "j.*")
    form = F.upper(F.coalesce(_full(F.col("filing_type")), F.lit("10-K")))
    sections = F.array(*[F.struct(F.lit("Item " + k.split("_")[1]).alias("item"), F.lit(t).alias("title"), F.col(k).alias("body")) for k, t in ITEMS.items()])
    stem = F.regexp_replace("file", r"\.json$", "")
    out = j.select(
        F.coalesce(_full(F.col("filename")), F.col("file")).alias("source_file"), F.coalesce(_full(F.col("company")), stem).alias("company"), "cik", F.lit(None).cast("string").alias("ticker"), form.alias("form_type"),
        F.nullif(F.substring("period_of_report", 1, 4), F.lit("")).alias("fiscal_year"), F.col("filing_date").alias("filed_date"), F.explode(sections).alias("s"),
    )
    return out.where(F.col("form_type").startswith("10-K") & (F.length(F.trim("s.body")) >= MIN_SECTION)).select("source_file", "company", "cik", "ticker", "form_type", "fiscal_year", "filed_date", "s.*")


def read_submissions(spark: SparkSession, path: str | list[str], min_bytes: int = MIN_RAW_BYTES) -> DataFrame:
    """Raw submissions by their header and headings: the columns of ``read_side_files``."""
    raw = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_size") > min_bytes).select("value", F.col("_metadata.file_name").alias("source_file"))
    head = F.substring("value", 1, HEADER_CHARS)
    h = raw.select("source_file", "value", *[_full(F.regexp_extract(head, p, 1)).alias(n) for n, p in HEADER.items()])
    year = F.coalesce(F.substring("period", 1, 4), _full(F.regexp_extract("source_file", r"((?:19|20)\d{2})", 1)))
    cik = F.coalesce("cik", _full(F.regexp_extract("source_file", r"^(\d{4,10})", 1)))
    h = h.select("source_file", "value", "company", cik.alias("cik"), "ticker", F.upper(F.coalesce("form_type", F.lit("10-K"))).alias("form_type"), year.alias("fiscal_year"), "filed_date")
    return split_sections(strip_markup(h.where(F.col("form_type").startswith("10-K")), "value").drop("value"), "plain")


def load_filings(spark: SparkSession, side: str | None, raw: str | None, limit: int = 25, preferred: tuple[str, ...] = (), min_bytes: int = MIN_RAW_BYTES) -> DataFrame:
    """Sections of the first ``limit`` filings (0: all): from side files if any has a section, else from the largest raw
    submissions, of which only ``limit`` are parsed. No section at all is an error."""
    if side:
        found = read_side_files(spark, side)
        if not found.isEmpty():
            return prioritised(found, preferred, limit)
    if raw:
        sizes = spark.read.format("binaryFile").load(raw).select("path", "length").where(F.col("length") > min_bytes).orderBy(F.col("length").desc(), "path")
        paths = [r["path"] for r in (sizes.limit(limit) if limit else sizes).collect()]  # one row per file that is parsed
        if paths:
            found = read_submissions(spark, paths, min_bytes)
            if not found.isEmpty():
                return prioritised(found, preferred, limit)
    raise FileNotFoundError("no filing with a section")


def prioritised(sections: DataFrame, preferred: tuple[str, ...], limit: int = 25) -> DataFrame:
    """Sections of the first ``limit`` filings (0: all): preferred companies first, then those with most text."""
    like = F.exists(F.array(*[F.lit(p.upper()) for p in preferred]), lambda p: F.contains(F.upper(F.coalesce("company", F.lit(""))), p)) if preferred else F.lit(False)
    f = sections.groupBy("source_file").agg(F.max(like).alias("__pref"), F.sum(F.length("body")).alias("__chars")).orderBy(F.col("__pref").desc(), F.col("__chars").desc(), "source_file")
    return sections.join(f.limit(limit) if limit else f, "source_file", "left_semi")
