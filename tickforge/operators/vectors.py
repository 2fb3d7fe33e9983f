"""An index of vectors by inverted lists, for sets of queries where scoring every vector for every query is too much.

Centroids come from k-means on a bounded sample (``SAMPLE`` vectors, the first by a hash of the id); every vector is put
into the list of its nearest centroid. A query looks into the ``probes`` lists nearest to it and scores their vectors
exactly, in blocks, so that a list of any size is many tasks. ``calibrated`` raises ``probes`` until the recall against
the whole search reaches a target for a bounded set of queries; the whole search is ``retrieval.dense_search_set``.

Defined cases: null vectors are not indexed and have no hits; vectors of zeros have the score 0 with all; ties go to the
smaller id; an index of no vectors has no hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.operators import retrieval
from tickforge.workspace import written

SAMPLE, MOST_LISTS, ROUNDS = 20_000, 1024, 12
#: Queries that the recall is measured with, and vectors of a list in one block.
CALIBRATION, LIST_BLOCK = 200, 8192


def _unit(v: pa.Array) -> np.ndarray:
    return retrieval._matrix(pa.chunked_array([v])) if len(v) else np.zeros((0, 1))


def centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit vectors; a centroid that loses all its vectors starts anew from one that fits badly."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(ROUNDS):
        score = sample @ c.T
        of, fit = score.argmax(1), score.max(1)
        new = np.zeros_like(c)
        np.add.at(new, of, sample)
        empty = np.flatnonzero(np.bincount(of, minlength=lists) == 0)
        new[empty] = sample[np.argsort(fit, kind="stable")[: len(empty)]]
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        c = new / np.where(norm > 0, norm, 1.0)
    return c


class VectorIndex:
    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None, probes: int = 8):
        self.spark, self.probes = vectors.sparkSession, probes
        v = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        rows = v.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
        sample = _unit(pa.array([r[0] for r in rows], pa.list_(pa.float64())))
        n = v.count()
        self.lists = min(lists or max(1, round(n**0.5)), MOST_LISTS, max(1, len(sample)))
        self.centroids = centroids(sample, self.lists) if len(sample) else np.zeros((1, 1))
        c = self.centroids

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                of = (_unit(b.column(1)) @ c.T).argmax(1) if b.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(of.astype(np.int32))], ["id", "v", "list"])

        self.rows = written(v.mapInArrow(place, "id BIGINT, v ARRAY<DOUBLE>, list INT"), "lists")

    def search(self, queries: DataFrame, k: int = retrieval.TOP_K, vec_col: str = "embedding", probes: int | None = None) -> DataFrame:
        """query_id, id, score, rank. ``queries``: query_id and a vector."""
        c, most = self.centroids, min(probes or self.probes, self.lists)
        q = queries.where(F.col(vec_col).isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col(vec_col).cast("array<double>").alias("v"))

        def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                near = np.argsort(-(_unit(b.column(1)) @ c.T), axis=1, kind="stable")[:, :most].reshape(-1)
                at = pa.array(np.repeat(np.arange(b.num_rows), most))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(near.astype(np.int32))], ["query_id", "v", "list"])

        aimed = q.mapInArrow(aim, "query_id BIGINT, v ARRAY<DOUBLE>, list INT")
        sizes = self.rows.groupBy("list").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("blocks"))  # one row per list
        left = self.rows.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "v")
        right = aimed.join(F.broadcast(sizes), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query_id", "v")
        none = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

        def score(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return none
            return retrieval._best(b["query_id"].to_numpy(), a["id"].to_numpy(), retrieval._matrix(b["v"]) @ retrieval._matrix(a["v"]).T, k, False)

        hits = left.groupBy("list", "block").cogroup(right.groupBy("list", "block")).applyInArrow(score, "query_id BIGINT, id BIGINT, score DOUBLE")
        return retrieval.best_of_each(hits, k)

    def recall(self, queries: DataFrame, k: int = retrieval.TOP_K, vec_col: str = "embedding", probes: int | None = None) -> float:
        """The share of the whole search's hits that the index finds, by score: a tie at the end of a list counts as found."""
        exact = retrieval.dense_search_set(self.rows.select(F.col("id").alias("vec_id"), F.col("v").alias(vec_col)), queries.select("query_id", F.col(vec_col).cast("array<double>").alias(vec_col)), k)
        worst = exact.groupBy(F.col("query_id").alias("q")).agg(F.min("score").alias("least"), F.count("*").alias("n"))
        found = self.search(queries, k, vec_col, probes).join(worst, F.col("query_id") == F.col("q")).where(F.col("score") >= F.col("least")).count()
        wanted = worst.agg(F.sum("n")).first()[0]
        return found / wanted if wanted else 1.0

    def calibrated(self, queries: DataFrame, target: float = 0.95, k: int = retrieval.TOP_K, vec_col: str = "embedding") -> VectorIndex:
        """Double ``probes`` until a bounded set of ``queries`` has the target recall; all lists are the whole search."""
        some = written(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION), "calibration")
        while self.probes < self.lists and self.recall(some, k, vec_col) < target:
            self.probes = min(2 * self.probes, self.lists)
        return self
