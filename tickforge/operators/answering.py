"""A stored index of chunks, and the chain from questions to cited answers over it.

``ChunkIndex`` is one versioned table: chunks with their vectors, in buckets by chunk id, and beside them, in the same
commit, how many chunks have each term, in buckets by term. A build adds what is new, deletes what is no longer there and embeds nothing
else. Questions come as a set: fused dense and sparse rankings, reranked passages, answers with checked citations, and an
audit row per question. Embedder, scorer and generator are plug-ins (``Plugins``) with offline defaults.

Defined cases: chunks with the same id are one; a question without words has no sparse list; without passages an answer
is the canned refusal; an empty corpus is an error, as an index of nothing answers nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.operators import retrieval, sets, text
from tickforge.operators.tables import VersionedTable
from tickforge.workspace import written

# What a refusal says, and the words by which one is known.
REFUSAL = "The passages do not contain enough information to answer."
REFUSED_BY = "do not contain enough information"
TERMS = T.StructType([T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("cf", T.LongType()), T.StructField("__bucket", T.StringType())])


class PluginUnavailable(RuntimeError):
    """A plug-in says that it can't be used, and why."""


def hashed(texts: DataFrame) -> DataFrame:
    """Offline embedder. ``texts``: id, text and any others; adds ``embedding``, null for texts without tokens."""
    return retrieval.hashed_rows(texts, "text")


def overlap(pairs: DataFrame) -> DataFrame:
    """Offline scorer: the share of the question's distinct tokens that the passage has. Adds ``rerank_score``."""
    q = F.array_distinct(retrieval.tokens(F.col("question")))
    share = F.round(F.size(F.array_intersect(q, retrieval.tokens(F.col("text")))) / F.greatest(F.lit(1.0), F.size(q).cast("double")), 6)
    return pairs.withColumn("rerank_score", F.when(F.size(q) > 0, share))


def extracts(prompts: DataFrame) -> DataFrame:
    """Offline generator: the first sentence of each passage with its marker. Adds ``answer``. ``passages`` is an array of
    (final_rank, label, text) in order."""
    first = lambda p: F.coalesce(F.nullif(F.regexp_extract(p["text"], r"(?s)^(.*?[.!?])(\s|$)", 1), F.lit("")), retrieval.excerpt(p["text"]))
    said = F.transform("passages", lambda p: F.concat(first(p), F.lit(" [S"), p["final_rank"].cast("string"), F.lit("]")))
    return prompts.withColumn("answer", F.when(F.size("passages") > 0, F.array_join(said, " ")).otherwise(REFUSAL))


@dataclass(frozen=True)
class Plugins:
    """``embed`` gets (id, text) with columns of the index beside them and adds ``embedding`` (one that gives back less than it
    gets is joined by id), ``score`` gets (question, text) and adds ``rerank_score``, ``generate``
    gets (question, passages, block) and adds ``answer``: all on DataFrames. ``query_prefix`` goes before questions only.
    ``ready`` returns None or why the plug-ins can't be used."""

    embed: Callable[[DataFrame], DataFrame] = hashed
    score: Callable[[DataFrame], DataFrame] = overlap
    generate: Callable[[DataFrame], DataFrame] = extracts
    query_prefix: str = ""
    ready: Callable[[], str | None] = lambda: None

    def check(self) -> Plugins:
        if why := self.ready():
            raise PluginUnavailable(why)
        return self


class ChunkIndex:
    BUCKETS = 16

    def __init__(self, spark: SparkSession, path: str, plugins: Plugins = Plugins()):
        self.spark, self.plugins = spark, plugins
        self.table = VersionedTable(spark, path)

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.BUCKETS)).cast("string")

    def build(self, sections: DataFrame, reset: bool = False) -> dict[str, int]:
        """Bring the index to the chunks of ``sections`` (doc_id, source_file, item, text, and what a label takes)."""
        label = text.citation_label(*[F.col(c) for c in ("ticker", "company", "form_type", "fiscal_year", "item", "section_title")])
        made = text.chunks(sections).select("chunk_id", "doc_id", label.alias("label"), F.col("body").alias("text"))
        once = made.groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"), F.min_by("label", "doc_id").alias("label"), F.min_by("text", "doc_id").alias("text"))
        now = written(once.withColumn("__bucket", self._bucket("chunk_id")).hint("rebalance", F.col("__bucket")), "chunks")
        if now.isEmpty():
            raise ValueError("no chunk to index")
        schema = T.StructType([*now.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])
        if not self.table.exists():
            self.table.create(schema, partition_by="__bucket")
        base = self.table.manifest()
        old = self.table.read(base["version"]) if not reset else self.spark.createDataFrame([], self.table.schema)
        fresh = reset or not base["parts"]
        pending = now if fresh else now.join(old.select("chunk_id"), "chunk_id", "left_anti")
        vectors = self.plugins.check().embed(pending.withColumnRenamed("chunk_id", "id"))
        if set(now.columns) - {"chunk_id"} <= set(vectors.columns):
            embedded = vectors.withColumnRenamed("id", "chunk_id").select(*now.columns, "embedding")
        else:
            embedded = pending.join(vectors.select("id", "embedding"), F.col("chunk_id") == F.col("id"), "left").select(*now.columns, "embedding")
        stale = old.join(now.select("chunk_id"), "chunk_id", "left_anti")
        hit = [] if fresh else sorted(r[0] for r in stale.select("__bucket").distinct().collect())  # names of buckets
        added = self.table._write(embedded, "__bucket", rebalance=False)  # ``now`` is in buckets already
        counts = {"embedded": self.table._open(added, schema).count(), "removed": 0 if fresh else stale.count()}
        counts["reused"] = 0 if fresh else old.count() - counts["removed"]
        if hit:
            kept = self.table._write(old.where(F.col("__bucket").isin(hit)).join(now.select("chunk_id"), "chunk_id", "left_semi").select([f.name for f in schema]), "__bucket")
            added = {p: added.get(p, []) + kept.get(p, []) for p in {*added, *kept}}
        whole = reset or counts["removed"] > 0  # counts of deleted chunks stand in any bucket
        words = sets.term_counts((now if whole else pending).select(F.lower("text").alias("t"))).withColumn("__bucket", self._bucket("term"))
        files = self.table._write(words.select([f.name for f in TERMS]), "__bucket")
        n = {"chunks": counts["embedded"] + counts["reused"]}
        every = _terms(self.table._open(files if whole else _joined(base.get("side", {}).get("terms", {}), files), TERMS))
        stats = every.agg(F.avg(_idf(n["chunks"])).alias("mean_idf"), F.sum("cf").alias("words")).first()  # one row
        metrics = counts | n | {"mean_idf": stats["mean_idf"], "avgdl": (stats["words"] or 0) / n["chunks"]}
        self.table.put(base, "INDEX", metrics, added=added, dropped=None if reset else hit, side={"terms": (files, None if whole else ())})
        return counts

    def passages(self) -> DataFrame:
        return self.table.read().select(F.col("chunk_id").alias("id"), "label", "text")

    def dense(self, questions: DataFrame, k: int = retrieval.TOP_K) -> DataFrame:
        """query_id, id, score, rank."""
        prefixed = questions.select(F.col("query_id").alias("id"), F.concat(F.lit(self.plugins.query_prefix), F.col("question")).alias("text"))
        q = self.plugins.check().embed(prefixed.where(F.col("text").isNotNull())).select(F.col("id").alias("query_id"), "embedding")
        # vectors are compared under numbers, which the ids of chunks give back
        named = self.table.read().where(F.col("embedding").isNotNull()).select("chunk_id", F.xxhash64("chunk_id").alias("vec_id"), "embedding")
        hits = retrieval.dense_search_set(named.select("vec_id", "embedding"), q, k)
        return hits.join(named.select("chunk_id", "vec_id"), F.col("id") == F.col("vec_id")).select("query_id", F.col("chunk_id").alias("id"), "score", "rank")

    def sparse(self, questions: DataFrame, k: int = retrieval.TOP_K) -> DataFrame:
        """BM25 over the stored chunks by the stored counts of terms: query_id, id, score, rank."""
        m = self.table.manifest()
        n = m["metrics"]
        worth = _terms(self.table.read_side("terms", TERMS, version=m["version"])).select("term", retrieval.bm25_weight(_idf(n["chunks"]), n["mean_idf"]).alias("w"))
        chunks = self.table.read(m["version"]).select("chunk_id", "text")
        return retrieval.sparse_search_weighted(chunks, questions, worth, n["avgdl"], k, "chunk_id", "text")


def _terms(counted: DataFrame) -> DataFrame:
    """term, df, cf over all builds."""
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _idf(chunks: int) -> Column:
    return F.ln(F.lit(chunks) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)


def _joined(a: dict, b: dict) -> dict:
    return {p: a.get(p, []) + b.get(p, []) for p in {*a, *b}}


def hybrid_search(index: ChunkIndex, questions: DataFrame, k: int = retrieval.TOP_K) -> DataFrame:
    """The fused list of each question, with the ranks and scores of both retrievers."""
    return retrieval.fuse({"dense": index.dense(questions, k), "sparse": index.sparse(questions, k)}, by=("query_id",))


def rerank_passages(index: ChunkIndex, fused: DataFrame, questions: DataFrame, n: int = retrieval.RERANK_N) -> DataFrame:
    """The n best of each fused list by the scorer, numbered: query_id, id, before, rerank_score, final_rank, label, text. A
    score of 0 is a score; a missing one counts as 0."""
    pairs = fused.select("query_id", "id", F.col("final_rank").alias("before")).join(index.passages(), "id").join(questions, "query_id")
    scored = index.plugins.score(pairs).withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))
    return retrieval.best_of_each(scored.withColumnRenamed("rerank_score", "score"), n, tie="before").withColumnRenamed("score", "rerank_score").withColumnRenamed("rank", "final_rank").select("query_id", "id", "before", "rerank_score", "final_rank", "label", "text")


def answer_questions(index: ChunkIndex, questions: DataFrame, k: int = retrieval.TOP_K, n: int = retrieval.RERANK_N) -> tuple[DataFrame, DataFrame]:
    """(answers, audit). Answers: query_id, question, answer, refused, sources_supplied, warnings. Audit: query_id,
    candidates, found_by_both, promoted, demoted, cited, unresolved."""
    fused = written(hybrid_search(index, questions, k), "fused")
    best = written(rerank_passages(index, fused, questions, n), "passages")
    line = F.concat(F.lit("[S"), F.col("final_rank").cast("string"), F.lit("] "), F.col("label"), F.lit("\n"), F.col("text"))
    supplied = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("final_rank", "label", "text", line.alias("line")))).alias("passages"))  # at most n
    prompts = questions.join(supplied, "query_id", "left")
    empty = F.array().cast("array<struct<final_rank:bigint,label:string,text:string,line:string>>")
    prompts = prompts.withColumn("passages", F.coalesce("passages", empty)).withColumn("block", F.array_join(F.transform("passages", lambda p: p["line"]), "\n\n"))
    said = index.plugins.check().generate(prompts).select("query_id", "question", "answer", F.size("passages").alias("sources_supplied"))
    said = written(said.withColumn("refused", F.contains(F.lower("answer"), F.lit(REFUSED_BY))), "answers")
    cited = retrieval.citations(said, "query_id", "answer", "sources_supplied").groupBy(F.col("id").alias("c_id")).agg(F.count("*").alias("cited"), F.count_if(~F.col("resolved")).alias("unresolved"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    said = said.join(cited, F.col("query_id") == F.col("c_id"), "left").select(*said.columns, zero("cited"), zero("unresolved"))
    warn = F.array_compact(F.array(F.when(F.col("unresolved") > 0, "The answer cites a source that was not supplied."), F.when((F.col("cited") == 0) & ~F.col("refused"), "The answer cites no source.")))
    said = said.withColumn("warnings", warn)
    both = fused.groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if(F.size("retrievers") > 1).alias("found_by_both"))
    moved = retrieval.moves(fused, best, n, ("query_id",)).groupBy("query_id").agg(F.count_if(F.col("move") == "promoted").alias("promoted"), F.count_if(F.col("move") == "demoted").alias("demoted"))
    audit = said.select("query_id", "cited", "unresolved").join(both, "query_id", "left").join(moved, "query_id", "left")
    return said.drop("cited", "unresolved"), audit.select("query_id", *[zero(c) for c in ("candidates", "found_by_both", "promoted", "demoted")], "cited", "unresolved")


def citation_warnings(answers: DataFrame, id_col: str = "answer_id") -> DataFrame:
    """id, warning of answers (answer, refused, sources_supplied) that cite what wasn't supplied, or cite nothing and aren't
    refusals."""
    c = retrieval.citations(answers, id_col, "answer", "sources_supplied").groupBy(F.col("id").alias("c_id")).agg(F.count_if(~F.col("resolved")).alias("unresolved"), F.count("*").alias("cited"))
    j = answers.join(c, F.col(id_col) == F.col("c_id"), "left")
    unknown = F.coalesce("unresolved", F.lit(0)) > 0
    bare = (F.coalesce("cited", F.lit(0)) == 0) & ~F.coalesce("refused", F.lit(False))
    return j.where(unknown | bare).select(id_col, F.when(unknown, "unknown source").otherwise("no citation").alias("warning"))


def recorded_summary(answers: DataFrame) -> DataFrame:
    """One row over recorded answers: answers, refused by flag, with markers, with warnings, declined by wording."""
    return answers.agg(
        F.count("*").alias("answers"), F.count_if("refused").alias("refused"), F.count_if(F.contains("answer", F.lit("[S"))).alias("with_markers"), F.count_if(F.size("warnings") > 0).alias("with_warnings"),
        F.count_if(F.contains(F.lower("answer"), F.lit(REFUSED_BY))).alias("declined"),
    )


def demo_summary(answers: DataFrame, audit: DataFrame) -> DataFrame:
    """One row: questions, answered, refused, with_citations, with_warnings, reranker_changed."""
    j = answers.join(audit, "query_id")
    return j.agg(
        F.count("*").alias("questions"), F.count_if(~F.col("refused")).alias("answered"), F.count_if("refused").alias("refused"), F.count_if(F.col("cited") > 0).alias("with_citations"),
        F.count_if(F.size("warnings") > 0).alias("with_warnings"), F.count_if(F.col("promoted") > 0).alias("reranker_changed"),
    )
