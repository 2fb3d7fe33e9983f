"""Implausible readings: impossible values, spikes and stuck values, each relative to its own source.

A Kalman filter with a local-level model runs over the logarithms of each source's field. Level noise ``q`` and reading
noise ``r`` are the source's own, from the medians of its changes over one and over two readings: 1.4826 times the first
is sqrt(q + 2r), 1.4826 times the second is sqrt(2q + 2r). A standardised innovation above ``INNOVATION_LIMIT`` flags the
reading and withholds the update; after ``RELOCK`` withheld readings in a row the filter takes the new level.

Spikes start at a reading that the filter flags, or at the one after (its level then isn't the last reading). Only there
the neighbour test of one to three readings is made. The filter loses none: for a reading whose predecessor was accepted,
the innovation's deviation is at most sqrt(q + 2r) and the level is within ``INNOVATION_LIMIT * r / sqrt(q + r)`` of the
predecessor, so a change of 12 usual ones, which are 8.09 sqrt(q + 2r), has a standardised innovation above 4.

Stuck values are stretches whose innovation variance vanishes: the mean square of ``STUCK_RUN - 1`` innovations in a row,
each less what the filter's own lag carries over from the reading before. There the raw readings are compared.

A source's series is cut into shards of ``SHARD`` readings by exact position, and each shard gets ``HALO`` readings of
its neighbours to warm up and to look ahead, so a source with a third of all rows is many tasks. Positions come from
a range sort and counts per range. A source of one shard has its medians there; those of longer ones come from
``grouped_median``, which gives the same values.

Defined cases: a null ticker is a source of its own; null fields break no rule; null and zero values of a field are
skipped for spikes and end a stuck run; NaN is impossible; a source whose usual change is 0 flags any change that
stands out on both sides; an empty table gives no row; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.scalars import norm_ticker, nvl_false
from tickforge.operators.quantiles import grouped_median
from tickforge.workspace import written

PRICES = ("open", "high", "low", "close")
FIELDS = ("close", "high", "low", "volume")
SPIKE_FACTOR = 12.0
SPIKE_LENGTH = 3
STUCK_RUN = 6
MIN_MESSAGES = 30
INNOVATION_LIMIT = 4.0
#: Of logarithms: a mean square of innovations below the square of this has vanished.
STILL = 1e-9
RELOCK = 4
SHARD, HALO = 4096, 32
_COUNTED = ("m", *FIELDS)


def impossible() -> Column:
    """Readings that cannot be true, whatever the source."""
    bad = [nvl_false((F.col(p) <= 0) | F.isnan(p)) for p in PRICES]
    bad += [nvl_false(F.col("high") < F.col("low")), nvl_false(F.col("volume") < 0)]
    bad += [nvl_false((F.col(p) > F.col("high")) | (F.col(p) < F.col("low"))) for p in ("open", "close")]
    return reduce(lambda a, b: a | b, bad)


# -- positions and shards ---------------------------------------------------------------------------------------


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running counts per source within a sorted range: of messages, and of usable readings per field (null if not usable)."""
    pid = TaskContext.get().partitionId()
    before, carry = None, dict.fromkeys(_COUNTED, 0)
    for b in batches:
        if not b.num_rows:
            continue
        tk = b.column("tk")
        code = pc.dictionary_encode(tk, null_encoding="encode").indices.to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))
        goes_on = before is not None and before[0] == tk[0].as_py()
        out = [tk, b.column("row_id"), *[b.column(f) for f in FIELDS]]
        for n in _COUNTED:
            use = np.ones(len(code), bool) if n == "m" else pc.fill_null(pc.greater(b.column(n), 0), False).to_numpy(zero_copy_only=False).astype(bool)
            total = np.cumsum(use)
            base = np.concatenate([[0], total])[starts]
            if goes_on:
                base[0] -= carry[n]
            at = total - base[run]
            carry[n] = int(at[-1])
            out.append(pa.array(at, pa.int64(), mask=~use))
        before = (tk[-1].as_py(),)
        yield pa.RecordBatch.from_arrays([*out, pa.array(np.full(len(code), pid), pa.int32())], ["tk", "row_id", *FIELDS, *[f"p_{n}" for n in _COUNTED], "pid"])


def _positions(left: DataFrame) -> DataFrame:
    """tk, row_id, the fields, the message's 1-based position ``p_m`` in its source and per field ``p_<field>`` among its
    usable readings. ``left``: tk, trade_date, event_ts, row_id, fields."""
    order = [F.col("tk").asc_nulls_first(), F.col("trade_date").asc_nulls_first(), F.col("event_ts").asc_nulls_first(), F.col("row_id")]
    kinds = dict(left.dtypes)
    schema = ", ".join([f"tk STRING, row_id {kinds['row_id']}", *[f"{f} {kinds[f]}" for f in FIELDS], *[f"p_{n} BIGINT" for n in _COUNTED], "pid INT"])
    local = written(left.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_number, schema), "numbered")
    counts = local.groupBy("tk", "pid").agg(*[F.coalesce(F.max(f"p_{n}"), F.lit(0)).alias(n) for n in _COUNTED])
    earlier = Window.partitionBy("tk").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("tk").alias("o_tk"), F.col("pid").alias("o_pid"), *[F.sum(n).over(earlier).alias(f"o_{n}") for n in _COUNTED]).where("o_m > 0")
    # a range goes on with at most one source of the range before it, so there are no more offsets than partitions
    joined = local.join(F.broadcast(offsets), F.col("tk").eqNullSafe(F.col("o_tk")) & (F.col("pid") == F.col("o_pid")), "left")
    return joined.select("tk", "row_id", *FIELDS, *[(F.col(f"p_{n}") + F.coalesce(f"o_{n}", F.lit(0))).alias(f"p_{n}") for n in _COUNTED])


def _shards(placed: DataFrame) -> DataFrame:
    """One row per message and shard that needs it: a message's home by its position and the homes and halos of its readings."""
    wanted = []
    for n in _COUNTED:
        at = F.col(f"p_{n}") - 1
        home, rest = F.floor(at / SHARD).cast("long"), at % SHARD
        wanted += [home] if n == "m" else [home, F.when((rest < HALO) & (home > 0), home - 1), F.when(rest >= SHARD - HALO, home + 1)]
    return placed.select("*", F.explode(F.array_distinct(F.array_compact(F.array(*wanted)))).alias("shard"))


def _readings(t: pa.Table, field: str, shard: int, size: int) -> dict[str, np.ndarray]:
    """The shard's readings of a field in order: x, pos, mpos, live, row_id, home (whether it is the shard's own)."""
    pos = t[f"p_{field}"].combine_chunks()
    at = pos.fill_null(0).to_numpy(zero_copy_only=False) - 1
    got = pos.is_valid().to_numpy(zero_copy_only=False) & (at >= shard * size - HALO) & (at < (shard + 1) * size + HALO)
    pick = np.flatnonzero(got)
    pick = pick[np.argsort(at[pick], kind="stable")]
    volume = t["volume"].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
    x = t[field].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
    return {"x": x[pick].astype(float), "pos": at[pick], "mpos": t["p_m"].to_numpy()[pick], "live": volume[pick] > 0, "row_id": t["row_id"].to_numpy()[pick], "home": at[pick] // size == shard}


def _steps(r: dict[str, np.ndarray], lag: int) -> np.ndarray:
    """Absolute changes of the logarithm over ``lag`` readings, of the shard's own readings."""
    y = np.log(r["x"])
    return np.abs(y[lag:] - y[:-lag])[r["home"][lag:]]


# -- the filter -------------------------------------------------------------------------------------------------


def noise(usual_1: float, usual_2: float) -> tuple[float, float]:
    """(q, r) of the level and of the readings, from the median changes over one and two readings."""
    one, two = (1.4826 * usual_1) ** 2, (1.4826 * usual_2) ** 2
    r = min(max(one - two / 2, 0.0), one / 2)
    return one - 2 * r, r


def kalman(y: np.ndarray, q: float, r: float, limit: float = INNOVATION_LIMIT, relock: int = RELOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flags, standardised innovations, innovations less what the level's lag carries over) of one ordered series. Flagged
    readings don't update the level; after ``relock`` of them in a row the filter starts again from the last."""
    n = len(y)
    flags, e_, s_, own = [False] * n, [0.0] * n, [1.0] * n, [np.inf] * n
    level, p, held, rest = None, 0.0, 0, 0.0
    lim2 = limit * limit
    for i, v in enumerate(y.tolist()):
        if level is None:
            level, p = v, r
            continue
        p += q
        e = v - level
        s = p + r
        e_[i], s_[i], own[i] = e, s, e - rest
        if e * e > lim2 * s:
            flags[i] = True
            held += 1
            if held >= relock:
                level, p, held, rest = v, r, 0, 0.0
            else:
                rest = e
        else:
            if s > 0:
                k = p / s
                level += k * e
                p *= 1 - k
            held = 0
            rest = v - level
    e_a, s_a = np.array(e_), np.array(s_)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(e_a == 0, 0.0, e_a / np.sqrt(s_a))
    return np.array(flags, bool), score, np.array(own)


def spikes_at(y: np.ndarray, usual: float, starts: np.ndarray) -> np.ndarray:
    """Members of stretches of one to three readings from one of ``starts`` that lie beyond both neighbours by the limit."""
    out, least, n = np.zeros(len(y), bool), SPIKE_FACTOR * usual, len(y)
    for g in range(1, SPIKE_LENGTH + 1):
        i = starts[(starts >= 1) & (starts + g < n)]
        mid = np.stack([y[i + j] for j in range(g)])
        before, after = y[i - 1], y[i + g]
        far = np.maximum(mid.min(0) - np.maximum(before, after), np.minimum(before, after) - mid.max(0))
        hit = i[(far >= least) & (far > 0)]
        for j in range(g):
            out[hit + j] = True
    return out


def stuck_at(own: np.ndarray, x: np.ndarray, mpos: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Members of stretches of ``STUCK_RUN`` readings whose innovation variance has vanished and which are live messages
    in a row with the same raw reading."""
    k = STUCK_RUN - 1
    out = np.zeros(len(x), bool)
    m = len(x) - k
    if m <= 0:
        return out
    variance = sum(np.minimum(np.abs(own[1 + j : 1 + j + m]), 1e9) ** 2 for j in range(k)) / k
    first = np.flatnonzero(variance <= STILL * STILL)
    same = np.ones(len(first), bool)
    for j in range(1, STUCK_RUN):
        same &= (x[first + j] == x[first]) & (mpos[first + j] == mpos[first] + j)
    for j in range(STUCK_RUN):
        same &= live[first + j]
    for j in range(STUCK_RUN):
        out[first[same] + j] = True
    return out


def judge_series(r: dict[str, np.ndarray], field: str, usual: tuple[float, float] | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(kind 0 none, 1 spike, 2 stuck; standardised innovation; number of readings where a neighbour test started)."""
    y = np.log(r["x"])
    if usual is None:
        return np.zeros(len(y), np.int8), np.zeros(len(y)), 0
    flags, score, own = kalman(y, *noise(*usual))
    kinds = np.zeros(len(y), np.int8)
    if field in ("close", "volume"):
        kinds[stuck_at(own, r["x"], r["mpos"], r["live"])] = 2
    starts = np.flatnonzero(flags | np.concatenate([[False], flags[:-1]]))
    kinds[spikes_at(y, usual[0], starts)] = 1
    return kinds, score, len(starts)


def _medians(t: pa.Table, shard: int, size: int) -> dict[str, tuple[float, float] | None]:
    out = {}
    for f in FIELDS:
        one, two = (_steps(_readings(t, f, shard, size), lag) for lag in (1, 2))
        out[f] = (float(np.median(one)), float(np.median(two)) if len(two) else 0.0) if len(one) else None
    return out


def _judge(t: pa.Table, size: int) -> pa.Table:
    shard = t["shard"][0].as_py()
    given = t.filter(t["usual"].is_valid())
    t = t.filter(t["row_id"].is_valid())
    out: dict[str, list] = {"row_id": [], "kind": [], "field": [], "innovation": []}
    if t.num_rows and pc.max(t["p_m"]).as_py() >= MIN_MESSAGES:
        if given.num_rows:
            u = given["usual"][0].as_py()
            usual = {f: (u[2 * k], u[2 * k + 1] or 0.0) if u[2 * k] is not None else None for k, f in enumerate(FIELDS)}
        else:
            usual = _medians(t, shard, size)
        for f in FIELDS:
            r = _readings(t, f, shard, size)
            kinds, score, _ = judge_series(r, f, usual[f])
            got = r["home"] & (kinds > 0)
            out["row_id"] += r["row_id"][got].tolist()
            out["kind"] += ["spike" if k == 1 else "stuck" for k in kinds[got]]
            out["field"] += [f] * int(got.sum())
            out["innovation"] += score[got].tolist()
    return pa.table({"row_id": pa.array(out["row_id"], pa.int64()), "kind": pa.array(out["kind"], pa.string()), "field": pa.array(out["field"], pa.string()), "innovation": pa.array(out["innovation"], pa.float64())})


def _long_sources(sharded: DataFrame) -> DataFrame:
    """For each shard of a source that has more than one: tk, shard, ``usual`` (median changes over one and two readings,
    field by field)."""
    long = sharded.where("shard > 0").select(F.col("tk").alias("l_tk")).distinct()
    size = SHARD  # workers have the module's own value
    rows = sharded.join(long, F.col("tk").eqNullSafe(F.col("l_tk")), "left_semi")

    def steps(t: pa.Table) -> pa.Table:
        shard, parts = t["shard"][0].as_py(), []
        for k, f in enumerate(FIELDS):
            r = _readings(t, f, shard, size)
            for lag in (1, 2):
                step = _steps(r, lag)
                parts.append(pa.table({"tk": t["tk"].slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(step), np.int64))), "what": pa.array(np.full(len(step), 2 * k + lag - 1), pa.int32()), "step": pa.array(step)}))
        return pa.concat_tables(parts)

    medians = grouped_median(rows.groupBy("tk", "shard").applyInArrow(steps, "tk STRING, what INT, step DOUBLE"), ["tk", "what"], "step", "usual")
    wide = medians.groupBy(F.col("tk").alias("u_tk")).agg(F.array(*[F.max(F.when(F.col("what") == k, F.col("usual"))) for k in range(2 * len(FIELDS))]).alias("usual"))
    return rows.select("tk", "shard").distinct().join(wide, F.col("tk").eqNullSafe(F.col("u_tk"))).select("tk", "shard", "usual")


def scored_readings(kept: DataFrame) -> DataFrame:
    """row_id, kind, field, innovation: every finding in every field, with the reading's standardised innovation (null for
    impossible values)."""
    cols = kept.select(norm_ticker(F.col("ticker")).alias("tk"), "trade_date", "event_ts", "row_id", *PRICES, "volume", impossible().alias("bad"))
    cols = written(cols, "readings")
    sharded = _shards(written(_positions(cols.where(~F.col("bad")).select("tk", "trade_date", "event_ts", "row_id", *FIELDS)), "placed"))
    rows = sharded.unionByName(_long_sources(sharded), allowMissingColumns=True)
    size = SHARD
    judged = rows.groupBy("tk", "shard").applyInArrow(lambda t: _judge(t, size), "row_id BIGINT, kind STRING, field STRING, innovation DOUBLE")
    none = F.lit(None)
    return judged.unionByName(cols.where("bad").select("row_id", F.lit("impossible").alias("kind"), none.cast("string").alias("field"), none.cast("double").alias("innovation")))


def flag_readings(kept: DataFrame) -> DataFrame:
    """row_id, kind of each implausible message of ``kept`` (one row per message). One kind per row: impossible before
    spike before stuck."""
    return scored_readings(kept).groupBy("row_id").agg(F.min("kind").alias("kind"))  # the kinds' names happen to sort by precedence
