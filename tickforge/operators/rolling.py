"""Rolling totals over trailing calendar days, by segment trees per entity and time shard.

A tree covers ``SHARD_DAYS`` consecutive days of one entity and is one row of a stored table: arrays of ``2 * SHARD_DAYS``
nodes with the sum and the count of each measure, node 1 at the root, day ``d`` of the shard at leaf ``SHARD_DAYS + d``.
A range of days is the sum of at most two nodes per level. As no window is longer than a shard, a day's window lies in
the shard's own tree and the one before. A late correction changes one leaf and its ancestors. What an entity has is
bounded by the days of the calendar, not by the number of its messages, which are reduced to days before the shuffle.

Totals of close are sums with a compensation term in every node, so they are those of the values as they stand: the sum's
rounding error doesn't depend on the tree's shape.

Defined cases: a null ticker is an entity of its own; rows without trade_date have no day and are left out; the day's
quote is the one with the latest event_ts (nulls last, then the largest row_id); null values are skipped in sums and
counts, NaN stays NaN and infinity infinity; an average over no value is null, and so is a total of volume
beyond 64 bits; days without a quote between the first and the last count 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.scalars import norm_ticker
from tickforge.workspace import written

SHARD_DAYS = 128
_NODES = 2 * SHARD_DAYS
#: Sum of close and its compensation; counts and sum of volume.
_REAL, _WHOLE = ("s_close", "c_close"), ("n_close", "s_volume", "n_volume")
_TREE = "ticker STRING, shard BIGINT, lo INT, hi INT, " + ", ".join([f"{m} ARRAY<DOUBLE>" for m in _REAL] + [f"{m} ARRAY<BIGINT>" for m in _WHOLE])
#: Trees that are worked on at once.
_PIECE = 256


def day_quotes(kept: DataFrame) -> DataFrame:
    """One row per ticker and day: the quote with the latest event_ts. ``kept`` has one row per message."""
    best = F.max(F.struct("event_ts", "row_id", "close", "volume"))  # a null event_ts sorts first
    q = kept.where(F.col("trade_date").isNotNull()).groupBy(norm_ticker(F.col("ticker")).alias("ticker"), "trade_date").agg(best.alias("q"))
    day = F.datediff("trade_date", F.lit("1970-01-01").cast("date"))
    return q.select("ticker", F.floor(day / SHARD_DAYS).cast("long").alias("shard"), F.pmod(day, F.lit(SHARD_DAYS)).alias("leaf"), F.col("q.close").alias("close"), F.col("q.volume").alias("volume"))


# -- trees as arrays: real (trees, nodes, 2) and whole (trees, nodes, 3) ----------------------------------------


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums with compensation: the last axis is (sum, compensation)."""
    with np.errstate(invalid="ignore"):
        s = a[..., 0] + b[..., 0]
        t = s - a[..., 0]
        e = (a[..., 0] - (s - t)) + (b[..., 0] - t)
        c = a[..., 1] + b[..., 1] + np.where(np.isfinite(s), e, 0.0)
    return np.stack([s, c], -1)


def _total(x: np.ndarray) -> np.ndarray:
    return x[..., 0] + np.where(np.isfinite(x[..., 0]), x[..., 1], 0.0)


def _refresh(real: np.ndarray, whole: np.ndarray, tree: np.ndarray, node: np.ndarray) -> None:
    """Recompute the ancestors of nodes of one level, up to the roots."""
    while node.size and node[0] > 1:
        both = np.unique(tree * _NODES + (node >> 1))
        tree, node = np.divmod(both, _NODES)
        real[tree, node] = _plus(real[tree, 2 * node], real[tree, 2 * node + 1])
        whole[tree, node] = whole[tree, 2 * node] + whole[tree, 2 * node + 1]


def _put(real: np.ndarray, whole: np.ndarray, tree: np.ndarray, leaves: pa.StructArray) -> None:
    """Set leaves (structs of leaf, close, volume) and refresh what stands above them."""
    at = leaves.field("leaf").to_numpy(zero_copy_only=False).astype(np.int64) + SHARD_DAYS
    close, volume = leaves.field("close"), leaves.field("volume")
    has_c, has_v = (x.is_valid().to_numpy(zero_copy_only=False) for x in (close, volume))
    real[tree, at, 0] = np.where(has_c, close.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)
    real[tree, at, 1] = 0.0
    whole[tree, at] = np.stack([has_c, np.where(has_v, volume.fill_null(0).to_numpy(zero_copy_only=False), 0), has_v], -1)
    _refresh(real, whole, tree, at)


def _matrices(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The trees of a batch; a null tree is one of zeros."""
    out = []
    for names, kind in ((_REAL, np.float64), (_WHOLE, np.int64)):
        m = np.zeros((b.num_rows, _NODES, len(names)), kind)
        for k, name in enumerate(names):
            c = b.column(name)
            m[c.is_valid().to_numpy(zero_copy_only=False), :, k] = c.flatten().to_numpy(zero_copy_only=False).reshape(-1, _NODES)
        out.append(m)
    return out[0], out[1]


def _tree_columns(real: np.ndarray, whole: np.ndarray) -> dict[str, pa.Array]:
    offsets = pa.array(np.arange(len(real) + 1) * _NODES, pa.int32())
    put = lambda x: pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).reshape(-1)))
    return {m: put(real[:, :, k]) for k, m in enumerate(_REAL)} | {m: put(whole[:, :, k]) for k, m in enumerate(_WHOLE)}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, _PIECE):
            yield b.slice(at, _PIECE)


def _flattened(lists: pa.ListArray) -> tuple[pa.StructArray, np.ndarray]:
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes)


def _by_shard(leaves: DataFrame) -> DataFrame:
    """The leaves of each ticker and shard as one list, of at most ``SHARD_DAYS``."""
    return leaves.repartition("ticker").groupBy("ticker", "shard").agg(F.collect_list(F.struct("leaf", "close", "volume")).alias("leaves"))


def build_trees(leaves: DataFrame) -> DataFrame:
    """One row per ticker and shard that has a quote."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            items, tree = _flattened(b.column("leaves"))
            real, whole = np.zeros((b.num_rows, _NODES, 2)), np.zeros((b.num_rows, _NODES, 3), np.int64)
            _put(real, whole, tree, items)
            yield pa.RecordBatch.from_pydict({"ticker": b.column("ticker"), "shard": b.column("shard"), "lo": b.column("lo"), "hi": b.column("hi")} | _tree_columns(real, whole))

    at = F.col("leaves.leaf")
    return _by_shard(leaves).select("ticker", "shard", F.array_min(at).cast("int").alias("lo"), F.array_max(at).cast("int").alias("hi"), "leaves").mapInArrow(build, _TREE)


def apply_corrections(trees: DataFrame, corrections: DataFrame) -> DataFrame:
    """Put corrected day quotes (columns of ``day_quotes``) into stored trees. Of a tree that has a correction only the
    corrected leaves and their ancestors change; a shard without a tree gets one; all other trees pass unchanged."""

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            items, tree = _flattened(b.column("leaves"))
            real, whole = _matrices(b)
            _put(real, whole, tree, items)
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in ("ticker", "shard", "lo", "hi")} | _tree_columns(real, whole))

    c = _by_shard(corrections).select(F.col("ticker").alias("c_ticker"), F.col("shard").alias("c_shard"), "leaves")
    both = trees.join(c, F.col("ticker").eqNullSafe(F.col("c_ticker")) & (F.col("shard") == F.col("c_shard")), "full_outer")
    hit, at = F.col("leaves").isNotNull(), F.col("leaves.leaf")
    fixed = both.where(hit).select(
        F.coalesce("ticker", "c_ticker").alias("ticker"), F.coalesce("shard", "c_shard").alias("shard"), F.least("lo", F.array_min(at)).cast("int").alias("lo"), F.greatest("hi", F.array_max(at)).cast("int").alias("hi"),
        *_REAL, *_WHOLE, "leaves",
    )
    return fixed.mapInArrow(update, _TREE).unionByName(both.where(~hit).select(trees.columns))


def range_sums(real: np.ndarray, whole: np.ndarray, tree: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of leaves left..right of each range's tree (empty where left > right), one level at a time for all ranges."""
    r, w = np.zeros((len(tree), real.shape[2])), np.zeros((len(tree), whole.shape[2]), np.int64)
    lo, hi = left + SHARD_DAYS, right + SHARD_DAYS + 1

    def add(at: np.ndarray, node: np.ndarray) -> None:
        r[at] = _plus(r[at], real[tree[at], node])
        w[at] += whole[tree[at], node]

    while (active := lo < hi).any():
        at = np.flatnonzero(active & (lo & 1 == 1))
        add(at, lo[at])
        lo[at] += 1
        at = np.flatnonzero(active & (hi & 1 == 1))
        hi[at] -= 1
        add(at, hi[at])
        lo, hi = lo >> 1, hi >> 1
    return r, w


def trailing(trees: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """For each ticker and calendar day between its first and last quote: totals, counts and averages over the trailing
    windows (days, the day itself included)."""
    if max(windows) > SHARD_DAYS or min(windows) < 1:
        raise ValueError(f"windows must have 1 to {SHARD_DAYS} days")
    w = Window.partitionBy("ticker")
    # a ticker's trees are one per shard of the calendar, whatever its messages
    in_order = trees.select("*", F.min("shard").over(w).alias("first"), F.max("shard").over(w).alias("last"), F.lead("shard").over(w.orderBy("shard")).alias("next"))
    in_order = in_order.sortWithinPartitions("ticker", "shard")
    fields = ", ".join(f"total_close_{n}d DOUBLE, total_volume_{n}d BIGINT, n_close_{n}d BIGINT, n_volume_{n}d BIGINT" for n in windows)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last tree before this piece
        for b in _pieces(batches):
            n = b.num_rows
            real, whole = _matrices(b)
            col = lambda c: b.column(c).cast(pa.int64()).fill_null(-(2**60)).to_numpy(zero_copy_only=False)
            shard, lo, hi, first, last, nxt = (col(c) for c in ("shard", "lo", "hi", "first", "last", "next"))
            beyond = None
            # row n has no quote, row n + 1 is the tree before the piece
            zero_r, zero_w = np.zeros((1, _NODES, 2)), np.zeros((1, _NODES, 3), np.int64)
            real = np.concatenate([real, zero_r, held[0] if held else zero_r])
            whole = np.concatenate([whole, zero_w, held[1] if held else zero_w])
            days_of = whole[:, SHARD_DAYS:, 1]
            if np.abs(days_of.astype(np.float64)).max() > 2.0**57:  # sums of a window may not fit into 64 bits
                running = np.concatenate([np.zeros((len(days_of), 1)), np.cumsum(days_of.astype(np.float64), axis=1)], axis=1)
                beyond = lambda t, a, z, running=running: np.where(a <= z, running[t, z + 1] - running[t, a], 0.0)
            previous = np.concatenate([[held[2] if held else -(2**60)], shard[:-1]])
            before = np.where((shard != first) & (previous == shard - 1), np.concatenate([[n + 1], np.arange(n - 1)]), n)
            # shards between a tree and the next one have no tree of their own
            times = np.where(shard == last, 1, nxt - shard)
            of = np.repeat(np.arange(n), times)
            step = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            own = np.where(step == 0, of, n)
            past = np.where(step == 0, before[of], np.where(step == 1, of, n))
            at = shard[of] + step
            a, z = np.where(at == first[of], lo[of], 0), np.where(at == last[of], hi[of], SHARD_DAYS - 1)
            days = z - a + 1
            e = np.repeat(np.arange(len(of)), days)
            d = np.arange(len(e)) - np.repeat(np.cumsum(days) - days, days) + a[e]
            out = {"ticker": b.column("ticker").take(pa.array(of[e])), "day": pa.array((d + at[e] * SHARD_DAYS).astype(np.int32)).cast(pa.date32())}
            for width in windows:
                left = d - width + 1
                r1, w1 = range_sums(real, whole, own[e], np.maximum(left, 0), d.copy())
                r2, w2 = range_sums(real, whole, past[e], np.where(left < 0, left + SHARD_DAYS, 1), np.where(left < 0, SHARD_DAYS - 1, 0))
                total, counts = _total(_plus(r1, r2)), w1 + w2  # whole numbers wrap around, so a sum that fits is right
                too_large = np.zeros(len(e), bool)
                if beyond:
                    about = beyond(own[e], np.maximum(left, 0), d) + beyond(past[e], np.where(left < 0, left + SHARD_DAYS, 1), np.where(left < 0, SHARD_DAYS - 1, 0))
                    too_large = (np.abs(about) >= 1.5 * 2.0**63) | ((np.abs(about) > 2.0**62) & ((counts[:, 1] < 0) != (about < 0)))
                out |= {
                    f"total_close_{width}d": pa.array(total, mask=counts[:, 0] == 0), f"total_volume_{width}d": pa.array(counts[:, 1], mask=(counts[:, 2] == 0) | too_large),
                    f"n_close_{width}d": pa.array(counts[:, 0]), f"n_volume_{width}d": pa.array(counts[:, 2]),
                }
            held = (real[n - 1 : n], whole[n - 1 : n], shard[-1])
            yield pa.RecordBatch.from_pydict(out)

    sums = in_order.mapInArrow(answer, f"ticker STRING, day DATE, {fields}")
    out = [F.col("ticker"), F.col("day")]
    for n in windows:
        out += [F.col(f"total_close_{n}d"), (F.col(f"total_close_{n}d") / F.col(f"n_close_{n}d")).alias(f"avg_close_{n}d"), F.col(f"total_volume_{n}d"), (F.col(f"total_volume_{n}d") / F.col(f"n_volume_{n}d")).alias(f"avg_volume_{n}d"), F.col(f"n_close_{n}d"), F.col(f"n_volume_{n}d")]
    return sums.select(*out)


def rolling_totals(kept: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Trees are built and stored once, then asked."""
    return trailing(written(build_trees(day_quotes(kept)), "trees"), windows)
