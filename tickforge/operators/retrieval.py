"""Sparse and dense retrieval, rank fusion, reranking, citations and index maintenance as DataFrame operators.

Query-side frames (terms of one question, one query vector, a ranked list of at most k hits) are small by construction
and may be broadcast. Corpus-side frames never are. Sets of queries may grow with the corpus: they are scored block by
block (``QUERY_BLOCK`` queries against ``CORPUS_BLOCK`` rows) where the corpus is read, see ``sets``, and of each block at
most k hits a query go on."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.operators import sets
from tickforge.workspace import written

# Fixed values of the public BM25 variant and of rank fusion.
K1, B, EPSILON, RRF_K = sets.K1, sets.B, 0.25, 60
TOP_K, RERANK_N, EXCERPT = 30, 6, 400
QUERY_BLOCK, CORPUS_BLOCK = 128, 98304
FILE_BLOCKS = 32  # blocks of queries in a file


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, term, tf, length."""
    t = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ts")).where(F.size("ts") > 0)
    return t.select("id", F.size("ts").alias("length"), F.explode("ts").alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))


def document_frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_scores(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (6 decimals) of all documents with a query term. Query terms count as often as they are asked."""
    spark = docs.sparkSession
    words = [w for w in _tokenise(query)]
    terms = spark.createDataFrame([(w, words.count(w)) for w in sorted(set(words))], "term STRING, qtf BIGINT")
    size = docs.agg(F.count("*").alias("N"), F.avg(F.coalesce(F.size(tokens(F.col(text_col))), F.lit(0))).alias("avgdl"))
    posts = postings(docs, id_col, text_col)
    dfs = document_frequencies(posts)
    idf = F.ln(F.col("N") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    weighted = dfs.crossJoin(F.broadcast(size)).withColumn("idf", idf)  # size is one row
    mean = weighted.agg(F.avg("idf").alias("mean_idf"))
    wanted = weighted.join(F.broadcast(terms), "term").crossJoin(F.broadcast(mean)).withColumn("w", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")) * F.col("qtf"))
    hit = posts.join(F.broadcast(wanted.select("term", "w", "avgdl")), "term")  # as many rows as the question has terms
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    return hit.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))


def _tokenise(text: str) -> list[str]:
    import re

    return re.findall(r"[a-z0-9]+", text.lower())


def ranked(scores: DataFrame, k: int, positive_only: bool = False) -> DataFrame:
    """The k best by score, ties by id, with 1-based ``rank``. Top-k first, so the window sees k rows."""
    top = scores.orderBy(F.col("score").desc(), "id").limit(k)
    if positive_only:
        top = top.where(F.col("score") > 0)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")).cast("bigint"))


def sparse_search(docs: DataFrame, query: str, k: int = TOP_K, **cols) -> DataFrame:
    return ranked(bm25_scores(docs, query, **cols), k, positive_only=True)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalised(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(v.cast("array<double>"))


def dense_search(vectors: DataFrame, query: list[float], k: int = TOP_K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Exact cosine top-k against every vector."""
    norm = math.sqrt(sum(x * x for x in query)) or 1.0
    q = F.array(*[F.lit(float(x) / norm) for x in query])
    scores = vectors.select(F.col(id_col).alias("id"), F.round(dot(normalised(F.col(vec_col)), q), 6).alias("score"))
    return ranked(scores, k)


def _best(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, positive_only: bool) -> pa.Table:
    """The k best of each line of ``scores`` (queries x ids), ties by id."""
    low = -np.round(scores, 6)
    edge = np.partition(low, min(k, low.shape[1]) - 1, axis=1)[:, min(k, low.shape[1]) - 1]
    q, d = np.nonzero((low <= edge[:, None]) & (low < 0 if positive_only else True))
    order = np.lexsort((ids[d], low[q, d], q))
    q, d = q[order], d[order]
    keep = np.arange(q.size) - np.searchsorted(q, q) < k
    q, d = q[keep], d[keep]
    return pa.table({"query_id": query_ids[q], "id": ids[d], "score": -low[q, d] + 0.0})


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Normalised vectors as lines; vectors of zeros stay."""
    v = vectors.combine_chunks()
    m = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.float64)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n > 0, n, 1.0)


def dense_search_set(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Exact cosine top-k of every query against every vector: query_id, id, score, rank. ``queries``: query_id and the
    vector under the same name as in ``vectors``. A null vector has no cosine; it is no hit and as a query has none."""
    c = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    q = queries.where(F.col(vec_col).isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col(vec_col).alias("v"))

    n, most = q.count(), QUERY_BLOCK

    def prepare(a: pa.Table) -> Callable[[pa.Table], Iterator[pa.Table]]:
        ids, m = a["id"].to_numpy(), _matrix(a["v"])

        def search(b: pa.Table) -> Iterator[pa.Table]:
            asked, v = b["query_id"].to_numpy(), _matrix(b["v"])
            for x in range(0, asked.size, most):
                few = [_best(asked[x : x + most], ids[y : y + sets.RANGE], v[x : x + most] @ m[y : y + sets.RANGE].T, k, False) for y in range(0, ids.size, sets.RANGE)]
                hits = pa.concat_tables(few)
                yield hits.take(pa.array(sets.best(hits["query_id"].to_numpy(), np.arange(hits.num_rows), hits["score"].to_numpy(), hits["id"].to_numpy(), k)))

        return search

    return sets.search_set(sets.spread(c, "id", CORPUS_BLOCK), q, n, prepare, k, CORPUS_BLOCK, FILE_BLOCKS * most)


def sparse_search_set(docs: DataFrame, questions: DataFrame, k: int = TOP_K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """BM25 top-k of every question against every document, as ``sparse_search`` has it for one: query_id, id, score, rank.
    ``questions``: query_id, question."""
    counts = written(sets.term_counts(docs.select(F.lower(text_col).alias("t"))), "terms")
    n = docs.count()
    words = counts.agg(F.sum("cf")).first()[0] or 0  # one row
    idf = F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    mean = counts.agg(F.avg(idf)).first()[0]  # one row
    return sparse_search_weighted(docs, questions, counts.select("term", bm25_weight(idf, mean).alias("w")), words / n if n else 0.0, k, id_col, text_col)


def bm25_weight(idf: Column, mean: float | None) -> Column:
    return F.when(idf < 0, EPSILON * F.lit(mean)).otherwise(idf)


def sparse_search_weighted(docs: DataFrame, questions: DataFrame, worth: DataFrame, avgdl: float, k: int, id_col: str, text_col: str) -> DataFrame:
    """``sparse_search_set`` with the weights of the terms (term, w) and the mean length of documents given."""
    asked = postings(questions, "query_id", "question").join(worth, "term").select(F.col("id").cast("long").alias("query_id"), "term", (F.col("w") * F.col("tf")).alias("w"))
    corpus = sets.spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "id", CORPUS_BLOCK).where(F.col("t").isNotNull()).select("id", F.lower("t").alias("t"))
    most = QUERY_BLOCK
    return sets.search_set(corpus, asked, questions.count(), lambda a: sets.TermBlock(a, avgdl, k, most), k, CORPUS_BLOCK, FILE_BLOCKS * most)


def fuse(rankings: dict[str, DataFrame], k: int = RRF_K, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion over list positions; each list's rank and score are kept, ties go to the earlier list and
    position. ``retrievers`` names the lists in their order. ``by``: the columns that tell the queries of a set apart."""
    parts = None
    for i, (name, r) in enumerate(rankings.items()):
        w = Window.partitionBy(*by).orderBy("rank", "id")  # at most k rows a list
        p = r.select(*by, "id", F.row_number().over(w).alias("pos"), F.lit(i).alias("list"), F.lit(name).alias("name"), F.col("rank").alias("r"), F.col("score").alias("s"))
        parts = p if parts is None else parts.unionByName(p)
    if parts is None:
        raise ValueError("no ranking")
    keep = [x for name in rankings for x in (F.max(F.when(F.col("name") == name, F.col("r"))).alias(f"{name}_rank"), F.max(F.when(F.col("name") == name, F.col("s"))).alias(f"{name}_score"))]
    seen = F.array_sort(F.collect_set(F.struct("list", "name")))
    out = parts.groupBy(*by, "id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("pos"))), 10).alias("rrf_score"), F.min(F.struct("list", "pos")).alias("first"), F.transform(seen, lambda x: x["name"]).alias("retrievers"), *keep)
    order = Window.partitionBy(*by).orderBy(F.col("rrf_score").desc(), "first.list", "first.pos")
    return out.withColumn("final_rank", F.row_number().over(order).cast("bigint")).drop("first")


def lexical_overlap(query: str) -> Callable[[Column], Column]:
    """Default scorer: the share of the question's distinct tokens that a passage has."""
    asked = sorted(set(_tokenise(query)))
    q = F.array(*[F.lit(w) for w in asked])
    return lambda text: F.round(F.size(F.array_intersect(q, tokens(text))) / F.lit(float(max(1, len(asked)))), 6)


def rerank(fused: DataFrame, texts: DataFrame, scorer: Callable[[Column], Column], n: int = RERANK_N) -> DataFrame:
    """The n best of a fused list by ``scorer``, with the rank they had before. ``texts``: id, text."""
    j = texts.join(F.broadcast(fused.select("id", F.col("final_rank").alias("before"))), "id").select("id", "before", F.coalesce(scorer(F.col("text")), F.lit(0.0)).alias("rerank_score"))
    top = j.orderBy(F.col("rerank_score").desc(), "before").limit(n)
    return top.withColumn("final_rank", F.row_number().over(Window.orderBy(F.col("rerank_score").desc(), "before")).cast("bigint"))


def rerank_set(fused: DataFrame, texts: DataFrame, questions: DataFrame, n: int = RERANK_N) -> DataFrame:
    """``rerank`` by token overlap for a set of queries: query_id, id, before, rerank_score, final_rank. ``questions``:
    query_id, question; a query without words scores 0 everywhere and keeps its order."""
    q = questions.select("query_id", F.array_distinct(tokens(F.col("question"))).alias("asked"))
    hits = F.sort_array(F.collect_list(F.struct(F.col("final_rank").alias("before"), "id")))  # two lists of at most k hits
    lists = fused.groupBy("query_id").agg(hits.alias("hits")).join(q, "query_id", "left").select("query_id", F.col("hits.id").alias("ids"), F.col("hits.before").alias("places"), F.coalesce("asked", F.array().cast("array<string>")).alias("asked"))
    docs = sets.spread(texts.select("id", F.col("text").alias("t")), "id", CORPUS_BLOCK).select("id", F.lower("t").alias("t"))
    kinds = f"query_id {fused.schema['query_id'].dataType.simpleString()}, id {fused.schema['id'].dataType.simpleString()}, before BIGINT, common INT"
    found = sets.each_block(docs, lists, lists.count(), sets.shared_words, kinds, CORPUS_BLOCK, FILE_BLOCKS * QUERY_BLOCK)
    size = q.select("query_id", F.greatest(F.lit(1.0), F.size("asked").cast("double")).alias("asked"))
    share = F.round(F.col("common") / F.coalesce("asked", F.lit(1.0)), 6)
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "before")
    return found.join(size, "query_id", "left").select("query_id", "id", "before", share.alias("rerank_score")).withColumn("final_rank", F.row_number().over(w).cast("bigint")).where(F.col("final_rank") <= n)


def moves(fused: DataFrame, reranked: DataFrame, n: int = RERANK_N, by: tuple[str, ...] = ()) -> DataFrame:
    """id, move: promoted into the first n by reranking, or demoted out of them."""
    key = [*by, "id"]
    before = fused.where(F.col("final_rank") <= n).select(key)
    after = reranked.select(key)
    return after.join(before, key, "left_anti").withColumn("move", F.lit("promoted")).unionByName(before.join(after, key, "left_anti").withColumn("move", F.lit("demoted")))


def citations(answers: DataFrame, id_col: str, text_col: str, supplied_col: str) -> DataFrame:
    """id, marker, source_index, first position, whether the marker points to a supplied source. One row per distinct marker."""
    m = answers.select(F.col(id_col).alias("id"), F.col(supplied_col).alias("supplied"), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(r"\[S(\d+)\]"), F.lit(1))).alias("pos", "n"))
    # a marker keeps its digits; an index beyond 64 bits is null and points to nothing
    plain = F.regexp_replace("n", r"^0+(?=\d)", "")
    g = m.select("id", "supplied", "pos", plain.alias("n")).groupBy("id", "supplied", "n").agg(F.min("pos").alias("first_pos")).withColumn("source_index", F.expr("try_cast(n AS BIGINT)"))
    known = F.coalesce((F.col("source_index") >= 1) & (F.col("source_index") <= F.col("supplied")), F.lit(False))
    return g.select("id", F.concat(F.lit("[S"), F.col("n"), F.lit("]")).alias("marker"), "source_index", "first_pos", known.alias("resolved"))


def excerpt(text: Column, n: int = EXCERPT) -> Column:
    return F.substring(text, 1, n)


def best_of_each(scores: DataFrame, k: int, by: str = "query_id", tie: str = "id") -> DataFrame:
    """The k best of each query by ``score``, ties by ``tie``, with 1-based ``rank``. Candidates of a query are first cut to k
    in each of a few dozen salted groups, so that a query with very many doesn't gather them in one task."""
    order = [F.col("score").desc(), F.col(tie)]
    salted = scores.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(32)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy(by, "__salt").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "__salt")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("bigint")).where(F.col("rank") <= k)


def index_sync(chunks: DataFrame, store: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, action: add what the store lacks, delete what is no longer there, keep the rest."""
    new = chunks.select(key).distinct().join(store.select(key), key, "left_anti").withColumn("action", F.lit("add"))
    stale = store.select(key).distinct().join(chunks.select(key), key, "left_anti").withColumn("action", F.lit("delete"))
    same = store.select(key).distinct().join(chunks.select(key), key, "left_semi").withColumn("action", F.lit("keep"))
    return new.unionByName(stale).unionByName(same)


def hashing_vectors(docs: DataFrame, id_col: str, text_col: str, dims: int = 64) -> DataFrame:
    """Offline default embedder: signed hashing of tokens into ``dims`` buckets, normalised. vec_id, embedding; texts without
    tokens have none."""
    every = hashed_rows(docs.select(F.col(id_col).alias("vec_id"), F.col(text_col).alias("__text")), "__text", dims)
    return every.where(F.col("embedding").isNotNull()).select("vec_id", "embedding")


def hashed_rows(docs: DataFrame, text_col: str, dims: int = 64) -> DataFrame:
    """All columns and ``embedding``, made row by row; null for texts without tokens."""
    signed = F.transform(tokens(F.col(text_col)), lambda t: ((F.pmod(F.xxhash64(t), F.lit(dims)) + 1) * F.when(F.xxhash64(F.lit(1), t) % 2 == 0, 1).otherwise(-1)).cast("int"))
    src = docs.withColumn("__h", signed)
    keep = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(keep)
            code, row = h.flatten().to_numpy(zero_copy_only=False), pc.list_parent_indices(h)
            x = np.bincount(row.to_numpy(zero_copy_only=False) * dims + np.abs(code) - 1, np.sign(code), minlength=b.num_rows * dims).reshape(-1, dims)
            length = np.sqrt((x * x).sum(axis=1, keepdims=True))
            v = pa.array((x / np.where(length > 0, length, 1.0)).reshape(-1))
            none = pc.fill_null(pc.list_value_length(h), 0).to_numpy(zero_copy_only=False) == 0
            at = np.append(np.arange(b.num_rows) * dims, b.num_rows * dims).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.ListArray.from_arrays(pa.array(at), v, mask=pa.array(none))], [*b.schema.names[:keep], "embedding"])

    return src.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


def extractive_answer(spark: SparkSession, query: str, passages: DataFrame) -> DataFrame:
    """Offline default generator: the first sentence of each passage with its marker, or a refusal without passages."""
    s = F.regexp_extract("text", r"(?s)^(.*?[.!?])(\s|$)", 1)
    line = F.concat(F.when(s != "", s).otherwise(excerpt(F.col("text"))), F.lit(" [S"), F.col("final_rank").cast("string"), F.lit("]"))
    got = passages.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", line.alias("l")))), lambda x: x["l"]), " ").alias("answer"), F.count("*").alias("n"))
    refused = F.col("n") == 0
    return got.select(F.lit(query).alias("question"), F.when(refused, "The passages do not contain enough information to answer.").otherwise(F.col("answer")).alias("answer"), refused.alias("refused"))
