"""Searches of sets of queries against a whole corpus, in which neither side is copied or shuffled.

The queries go into the shared folder, a bounded number in a file. Each task of the corpus holds up to one block of rows, reads one file of queries after the other and gives the k best of its rows for each query, so that only
blocks times k hits a query are shuffled. Tasks read the files through pyarrow, so the shared folder
must be one that pyarrow can open (a local or mounted path, HDFS)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.workspace import shared_path

K1, B = 1.5, 0.75
#: Rows of a block that are multiplied at once, the share of them from which a term counts as frequent there, and the
#: number of groups of columns whose maxima bound the k-th best score. MARKS: the most frequent terms, by which rows are put
#: in order.
RANGE, FREQUENT, GROUPS, MARKS = 8192, 0.1, 256, 16


def spread(corpus: DataFrame, key: str, block: int) -> DataFrame:
    """``corpus`` in partitions that keep all cores busy. Files are taken as they are split, unless one split has far more
    than its share of the rows (a file of one row group, say)."""
    counts = [r["count"] for r in corpus.groupBy(F.spark_partition_id()).count().collect()]  # one number a partition
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    tasks = cores * max(1, -(-sum(counts) // (block * cores)))
    if counts and max(counts) * tasks > 2 * sum(counts) + tasks * 64:
        return corpus.repartition(tasks, key)
    return corpus.coalesce(tasks)


def _open(path: str):
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path)
    return files, sorted(f.path for f in files.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".parquet"))


def _uri(df: DataFrame, path: str) -> str:
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def each_block(corpus: DataFrame, queries: DataFrame, n_queries: int, prepare: Callable[[pa.Table], Callable[[pa.Table], Iterator[pa.Table]]], out: str, block_rows: int, file_queries: int) -> DataFrame:
    """``prepare`` gets a block of rows of ``corpus`` and returns a function from a table of queries to tables of columns
    ``out``. ``queries``: query_id, one or more rows a query; every block meets all of them, a file at a time."""
    path = shared_path(corpus.sparkSession, "queries")
    queries.repartition(max(1, -(-n_queries // file_queries)), "query_id").write.option("compression", "zstd").parquet(path)
    uri = _uri(corpus, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = prepare(pa.Table.from_batches(held))
            held.clear()
            files, names = _open(uri)
            for name in names:
                with files.open_input_file(name) as f:
                    asked = pq.read_table(f)
                if asked.num_rows:
                    for hits in search(asked):
                        yield from hits.to_batches()

        held: list[pa.RecordBatch] = []
        for b in batches:
            while b.num_rows:
                room = block_rows - sum(x.num_rows for x in held)
                held.append(b.slice(0, room))
                b = b.slice(room)
                if b.num_rows:
                    yield from block(held)
        if held:
            yield from block(held)

    return corpus.mapInArrow(run, out)


def search_set(corpus: DataFrame, queries: DataFrame, n_queries: int, prepare: Callable[[pa.Table], Callable[[pa.Table], Iterator[pa.Table]]], k: int, block_rows: int, file_queries: int) -> DataFrame:
    """query_id, id, score, rank: the k best of each query. ``corpus``: id and what ``prepare`` takes; of each block it gives
    the k best as query_id, id, score."""
    hits = each_block(corpus, queries, n_queries, prepare, f"query_id BIGINT, id {corpus.schema['id'].dataType.simpleString()}, score DOUBLE", block_rows, file_queries)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def ordinals(ids: pa.ChunkedArray) -> np.ndarray:
    """The place of each id in their order."""
    place = np.empty(len(ids), np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return place


def best(query: np.ndarray, row: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query, ties by ``place`` of the row."""
    order = np.lexsort((place[row], -score, query))
    q = query[order]
    return order[np.arange(q.size) - np.searchsorted(q, q) < k]


def words(lower: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of lower-case texts, one after the other, and how many each text has: runs of ASCII letters and digits, as
    ``retrieval.tokens`` has them, but several times as fast."""
    parts = pc.split_pattern_regex(lower, "[^a-z0-9]+")
    every = parts.flatten()
    some = pc.greater(pc.binary_length(every), 0)
    row = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)[some.to_numpy(zero_copy_only=False)]
    return every.filter(some), np.bincount(row, minlength=len(lower))


class TermBlock:
    """A block of documents (id, lower-case text) as term weights. Scores of all pairs are added up in single precision: terms that are frequent in
    a range of documents as a product of matrices, the others along their postings. What comes within the error bound of
    the k-th best is then added up again in double precision, so the result is as exact as if all were."""

    def __init__(self, docs: pa.Table, avgdl: float, k: int, query_block: int):
        self.most, self.k = query_block, k
        texts = docs["t"].combine_chunks()
        every, length = zip(*(words(texts.slice(a, RANGE)) for a in range(0, len(texts), RANGE)))
        length, coded = np.concatenate(length).astype(np.int64), pa.chunked_array(every).dictionary_encode().combine_chunks()
        self.ids = docs["id"].filter(pa.array(length > 0))
        self.place, length = ordinals(self.ids), length[length > 0]
        self.terms, code = coded.dictionary, coded.indices.to_numpy()
        del docs, texts, every, coded
        self.n = len(length)
        if not self.n:
            return
        n, v, from_, cells = self.n, len(self.terms), np.append(0, np.cumsum(length)), []
        for a in range(0, n, RANGE):
            z = min(a + RANGE, n)
            cell, tf = np.unique(np.repeat(np.arange(z - a), length[a:z]) * v + code[from_[a] : from_[z]], return_counts=True)
            cells.append((np.bincount(cell // v, minlength=z - a), (cell % v).astype(np.int32), tf.astype(np.int32)))
        size, term, tf = (np.concatenate(x) for x in zip(*cells))
        del code, cells
        # documents that share frequent terms (those of one language, say) stand together
        self.marks = np.argsort(-np.bincount(term, minlength=v), kind="stable")[:MARKS]
        doc, key = np.repeat(np.arange(n, dtype=np.int32), size), np.zeros(n, np.int64)
        for bit, t in enumerate(self.marks):
            key[doc[term == t]] |= 1 << (MARKS - bit)
        self.order = np.argsort(key, kind="stable")
        begin, size = np.cumsum(size) - size, size[self.order]
        self.begin = np.append(0, np.cumsum(size))
        moved = np.arange(len(term)) + np.repeat(begin[self.order] - self.begin[:-1], size)
        self.term, tf, doc = term[moved], tf[moved], np.repeat(np.arange(n, dtype=np.int32), size)
        del term, moved
        self.part = tf * (K1 + 1) / (tf + np.repeat(K1 * (1 - B + B * length[self.order] / avgdl), size))
        self.products, rest = [], []
        for a in range(0, n, RANGE):
            z = min(a + RANGE, n)
            cells = slice(self.begin[a], self.begin[z])
            term, row, part = self.term[cells], doc[cells], self.part[cells].astype(np.float32)
            frequent = np.bincount(term, minlength=v) >= max(FREQUENT * (z - a), 1)
            dense, line = frequent[term], np.cumsum(frequent) - 1
            m = np.zeros((line[-1] + 1, z - a), np.float32)
            m[line[term[dense]], row[dense] - a] = part[dense]
            self.products.append((np.flatnonzero(frequent), m))
            rest.append((term[~dense], row[~dense], part[~dense]))
        term, row, part = (np.concatenate(x) for x in zip(*rest))
        by = np.argsort(term, kind="stable")
        self.post_doc, self.post_part, self.post_at = row[by].astype(np.int64), part[by], np.searchsorted(term[by], np.arange(v + 1))

    def __call__(self, asked: pa.Table) -> Iterator[pa.Table]:
        if not self.n:
            return
        code = pc.index_in(asked["term"], self.terms).combine_chunks()
        known = pc.is_valid(code).to_numpy(zero_copy_only=False)
        code, w = code.drop_null().to_numpy().astype(np.int64), asked["w"].to_numpy()[known]
        ids, query = np.unique(asked["query_id"].to_numpy()[known], return_inverse=True)
        key = np.zeros(ids.size, np.int64)
        for bit, t in enumerate(self.marks):
            key[query[code == t]] |= 1 << (MARKS - bit)
        order = np.argsort(key, kind="stable")
        place = np.empty(ids.size, np.int64)
        place[order] = np.arange(ids.size)
        query, ids = place[query], ids[order]
        by = np.argsort(query, kind="stable")
        query, code, w = query[by], code[by], w[by]
        at = np.searchsorted(query, np.arange(0, ids.size + self.most, self.most))
        wide = -(-self.n // GROUPS) * GROUPS
        scores = np.empty((min(self.most, ids.size), wide), np.float32)
        scores[:, self.n :] = -np.inf
        for i, first in enumerate(range(0, ids.size, self.most)):
            own = slice(at[i], at[i + 1])
            m = min(self.most, ids.size - first)
            q, d, s = self._block(query[own] - first, code[own], w[own], scores[:m])
            yield pa.table({"query_id": ids[first + q], "id": self.ids.take(pa.array(self.order[d])), "score": s})

    def _block(self, query: np.ndarray, code: np.ndarray, w: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m, groups = len(scores), scores.shape[1] // GROUPS
        weight = np.zeros((m, len(self.terms)))
        weight[query, code] = w
        used = np.zeros(len(self.terms), bool)
        used[code] = True
        for r, (terms, parts) in enumerate(self.products):
            some = np.flatnonzero(used[terms])
            if some.size > 0.75 * len(terms):  # cheaper than a copy of the lines that are asked
                some = slice(None)
            scores[:, r * RANGE : r * RANGE + parts.shape[1]] = weight[:, terms[some]].astype(np.float32) @ parts[some]
        begin, end = self.post_at[code], self.post_at[code + 1]
        some = np.flatnonzero(begin < end)
        for few in np.split(some, np.flatnonzero(np.diff(query[some])) + 1) if some.size else ():  # one query each
            slices = [slice(x, y) for x, y in zip(begin[few].tolist(), end[few].tolist())]
            worth = np.repeat(w[few].astype(np.float32), end[few] - begin[few])
            np.add.at(scores[query[few[0]]], np.concatenate([self.post_doc[x] for x in slices]), worth * np.concatenate([self.post_part[x] for x in slices]))
        # no sum is off by more than this; a part is at most K1 + 1
        slack = (np.bincount(query, minlength=m) + 8) * 1.2e-7 * (K1 + 1) * np.bincount(query, np.abs(w), minlength=m) + 1e-6
        tops = scores.reshape(m, groups, GROUPS).max(axis=1)
        edge = np.partition(tops, GROUPS - self.k, axis=1)[:, GROUPS - self.k] if self.k <= GROUPS else np.full(m, -np.inf)
        negative = np.bincount(query, w < 0, minlength=m) > 0  # else a sum is 0 only where no term is shared
        low = np.maximum(edge - slack, np.where(negative, -slack, 1e-30)).astype(np.float32)
        q, g = np.nonzero(tops >= low[:, None])
        pair, line = np.nonzero(scores.reshape(m, groups, GROUPS)[q, :, g] >= low[q, None])
        q, d = q[pair], line * GROUPS + g[pair]
        some = d < self.n
        q, d = q[some], d[some]
        exact = np.empty(q.size)
        for a in range(0, q.size, 1 << 14):
            qs, ds = q[a : a + (1 << 14)], d[a : a + (1 << 14)]
            size = self.begin[ds + 1] - self.begin[ds]
            off = np.cumsum(size) - size
            cells = np.arange(size.sum()) + np.repeat(self.begin[ds] - off, size)
            exact[a : a + (1 << 14)] = np.add.reduceat(weight[np.repeat(qs, size), self.term[cells]] * self.part[cells], off)
        exact = np.round(exact, 6)
        some = np.flatnonzero(exact > 0)
        some = some[best(q[some], d[some], exact[some], self.place[self.order], self.k)]
        return q[some], d[some], exact[some]


def shared_words(docs: pa.Table) -> Callable[[pa.Table], Iterator[pa.Table]]:
    """For a block of documents (id, lower-case text) a function from lists of hits (query_id, ids, places, asked: distinct
    words) to query_id, id, before, common: how many of the words a hit in this block has."""
    ids = docs["id"].combine_chunks()
    every, length = zip(*(words(docs["t"].combine_chunks().slice(a, RANGE)) for a in range(0, len(docs), RANGE)))
    coded, length = pa.chunked_array(every).dictionary_encode().combine_chunks(), np.concatenate(length)
    terms, code, begin = coded.dictionary, coded.indices.to_numpy(), np.append(0, np.cumsum(length))

    def count(lists: pa.Table) -> Iterator[pa.Table]:
        of, places, asked = (lists[c].combine_chunks() for c in ("ids", "places", "asked"))
        row = pc.index_in(of.flatten(), ids)
        here = np.flatnonzero(pc.is_valid(row).to_numpy(zero_copy_only=False))
        line = pc.list_parent_indices(of).to_numpy(zero_copy_only=False)[here]
        row = row.take(pa.array(here)).to_numpy(zero_copy_only=False)
        word = pc.index_in(asked.flatten(), terms)
        known = pc.is_valid(word).to_numpy(zero_copy_only=False)
        word, by = word.drop_null().to_numpy(zero_copy_only=False), pc.list_parent_indices(asked).to_numpy(zero_copy_only=False)[known]
        at, flag, common = np.searchsorted(by, np.arange(len(lists) + 1)), np.zeros(len(terms), bool), np.zeros(len(here), np.int32)
        for i, (x, d) in enumerate(zip(line.tolist(), row.tolist())):
            own = word[at[x] : at[x + 1]]
            flag[own] = True
            found = code[begin[d] : begin[d + 1]]
            common[i] = np.unique(found[flag[found]]).size
            flag[own] = False
        yield pa.table({"query_id": lists["query_id"].take(pa.array(line)), "id": ids.take(pa.array(row)), "before": places.flatten().take(pa.array(here)), "common": pa.array(common)})

    return count


def term_counts(lower: DataFrame) -> DataFrame:
    """term, df, cf of documents (column t, their lower-case text), counted where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every, length = words(b.column(0))
            coded = every.dictionary_encode()
            v, code = len(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
            if v:
                cell = np.unique(np.repeat(np.arange(b.num_rows), length) * v + code)
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(cell % v, minlength=v)), pa.array(np.bincount(code, minlength=v))], ["term", "df", "cf"])

    some = lower.select("t").where(F.col("t").isNotNull()).mapInArrow(run, "term STRING, df BIGINT, cf BIGINT")
    return some.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
