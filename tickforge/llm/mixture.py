"""Mixing sources to target weights by Poisson replication.

Each document has a uniform number from a seeded hash of its id (52 bits). Inverting a Poisson distribution with the
source's rate at that number gives its count of copies, cut at the source's cap; documents are exploded by their counts and
put in one global random order. The rate of a source is set so that its copies have the target number of tokens: counts
never fall when the rate grows, and a rate's size follows from the tokens above its thresholds, P(X <= k). Tokens are added
up per cell of the uniform number; the few cells in which the thresholds of the rate lie are then split ``REFINEMENTS``
times, down to 2 ** -33, so that shares are exact up to single documents instead of up to sampling noise, for small rates
as for large ones.

The total is the corpus's own size, or as much as the smallest source allows when all of it is repeated to its cap. Of the
corpus only ids and numbers of tokens are written; shares are counted over all documents with the counts that the mixture
has.

Defined cases: rows without source and sources without a target stay out; a target without documents is reported with
share 0; a null or empty text has 0 tokens and is copied like others of its source; rows with the same id get the same
count; a source at its cap has every document exactly that often.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.llm.encoding import VOCABULARY, count_tokens
from tickforge.workspace import replace_columns, written

BITS, FIRST_BITS, NEXT_BITS, REFINEMENTS = 52, 13, 10, 2
SEED = 20240


def poisson_steps(rate: float, cap: int) -> list[float]:
    """P(X <= k) for k = 0 .. cap - 1. The count of a document is how many of them lie below its uniform number."""
    if math.isinf(rate):
        return [0.0] * cap
    out, term, total = [], math.exp(-rate), 0.0
    for k in range(cap):
        total += term
        out.append(total)
        term *= rate / (k + 1)
    return out


def counts_at(u: np.ndarray, rate: float, cap: int) -> np.ndarray:
    return np.searchsorted(np.array(poisson_steps(rate, cap)), u, side="left")


def solve_rate(u: np.ndarray, tokens: np.ndarray, want: float, cap: int) -> float:
    """The smallest rate whose copies have ``want`` tokens or more, or the largest below if that is nearer; infinite if only
    full repetition does."""
    if want <= 0:
        return 0.0
    if want >= cap * tokens.sum() * (1 - 1e-12):
        return math.inf
    order = np.argsort(u)
    edges, above = u[order], np.concatenate([[0.0], np.cumsum(tokens[order][::-1])])[::-1]
    size = lambda r: sum(above[np.searchsorted(edges, t, side="right")] for t in poisson_steps(r, cap))
    lo, hi = 0.0, 1.0
    while size(hi) < want:
        lo, hi = hi, hi * 2
        if hi > 1e6:
            return math.inf
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if size(mid) < want else (lo, mid)
    return hi if abs(size(hi) - want) <= abs(want - size(lo)) else lo


def _hash(id_col: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(f"`{id_col}`"), F.lit(SEED)), 64 - BITS)


class _Cells:
    """The tokens of a source by cells of the uniform number: (first number, bits below, tokens)."""

    def __init__(self, rows):
        self.at = {int(c): (BITS - FIRST_BITS, float(t)) for c, t in rows}

    def middle(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(sorted(self.at), np.float64)
        width = np.array([2.0 ** self.at[int(k)][0] for k in keys])
        return (keys + width / 2) / 2.0**BITS, np.array([self.at[int(k)][1] for k in keys])

    def around(self, rates: list[float], cap: int, bits: int) -> list[int]:
        """The cells with ``bits`` bits below in which a threshold of one of ``rates`` lies, or between the two."""
        if not self.at or any(math.isinf(r) for r in rates):
            return []
        low, high = (np.array(poisson_steps(r, cap)) * 2.0**BITS for r in (max(rates), min(rates)))
        size = 2**bits
        return [c for c, (b, _) in self.at.items() if b == bits and any(c < h + size / 2 and c + size > x - size / 2 for x, h in zip(low, high))]


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, id_col: str = "doc_id", path: str = VOCABULARY, keep_tokens: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares). The mixture has the documents' columns, ``copy`` (1-based) and ``shuffle_key``, in the order of the
    last, with ``keep_tokens`` also ``n_tokens``; shares has one row per target."""
    spark = documents.sparkSession
    goals = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.collect()}  # one row per source
    docs = documents.where(F.col("source").isin(list(goals)))
    sized = count_tokens(docs.select(F.col(f"`{id_col}`").alias("id"), "source", "text"), path=path)
    sized = written(sized.select(_hash("id").alias("h"), "source", "n_tokens"), "sized")
    first = 2 ** (BITS - FIRST_BITS)
    # at most 2 ** FIRST_BITS rows per source
    rows = sized.groupBy("source", (F.floor(F.col("h") / first) * first).cast("long").alias("c")).agg(F.sum("n_tokens").alias("t")).collect()
    cells = {s: _Cells([(r["c"], r["t"]) for r in rows if r["source"] == s]) for s in goals}
    tokens = {s: sum(t for _, t in c.at.values()) for s, c in cells.items()}
    live = {s: g for s, g in goals.items() if tokens[s] > 0 and g[0] > 0}
    most = min((cap * tokens[s] / share for s, (share, cap) in live.items()), default=0.0)
    total = min(float(total_tokens) if total_tokens else float(sum(tokens.values())), most)
    rates = {s: solve_rate(*cells[s].middle(), total * share, cap) if s in live else 0.0 for s, (share, cap) in goals.items()}
    bits = BITS - FIRST_BITS
    for _ in range(REFINEMENTS):
        near = {s: cells[s].around([rates[s] * (1 - 2.0 ** (bits - BITS)), rates[s] * (1 + 2.0 ** (bits - BITS))], goals[s][1], bits) for s in live}
        if not any(near.values()):
            break
        size, finer = 2**bits, 2 ** (bits - NEXT_BITS)
        wanted = F.lit(False)
        for s, cs in near.items():
            if cs:
                wanted = wanted | ((F.col("source") == s) & (F.floor(F.col("h") / size) * size).cast("long").isin(cs))
        # at most 2 ** NEXT_BITS rows for each of the few cells
        split = sized.where(wanted).groupBy("source", (F.floor(F.col("h") / finer) * finer).cast("long").alias("c")).agg(F.sum("n_tokens").alias("t")).collect()
        for s, cs in near.items():
            for c in cs:
                del cells[s].at[c]
            cells[s].at |= {int(r["c"]): (bits - NEXT_BITS, float(r["t"])) for r in split if r["source"] == s}
        bits -= NEXT_BITS
        rates = {s: solve_rate(*cells[s].middle(), total * share, cap) if s in live else 0.0 for s, (share, cap) in goals.items()}
    cut = F.create_map(*[x for s, (_, cap) in goals.items() for x in (F.lit(s), F.array(*[F.lit(float(v)) for v in poisson_steps(rates[s], cap)]))])
    count = lambda h: F.size(F.filter(F.element_at(cut, F.col("source")), lambda p: p < (h + F.lit(0.5)) / F.lit(2.0**BITS)))
    counted = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("source_tokens"), F.sum(F.col("n_tokens") * count(F.col("h"))).alias("mixed_tokens"))
    table = spark.createDataFrame([(s, share, float(rates[s]), cap) for s, (share, cap) in goals.items()], "g_source STRING, target_share DOUBLE, rate DOUBLE, max_repeats INT")
    report = table.join(counted, F.col("g_source") == F.col("source"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    report = report.select(F.col("g_source").alias("source"), "target_share", zero("documents"), zero("source_tokens"), zero("mixed_tokens"), "rate", "max_repeats")
    whole = report.agg(F.sum("mixed_tokens").alias("all"))  # one row
    shares = report.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.coalesce(F.col("mixed_tokens") / F.nullif(F.col("all"), F.lit(0)), F.lit(0.0))).drop("all")
    n = count(_hash(id_col))
    body = count_tokens(docs, path=path) if keep_tokens else docs
    mixture = replace_columns(body, copy=F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))
    mixture = replace_columns(mixture, shuffle_key=F.xxhash64(F.col(f"`{id_col}`"), F.col("copy"), F.lit(SEED + 1)))
    return mixture.orderBy("shuffle_key", id_col, "copy"), shares
