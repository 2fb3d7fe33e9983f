"""Late and out-of-order events: per-period aggregates by event time that late records correct until a cut-off.

Each record has the clock of its own arrival: the watermark at that moment is the arrival time less the allowed
lateness. A record below it is diverted (``expired``); one that arrives after its period ended corrects the period
(``late``).

``PeriodStore`` is the keyed state: a versioned table of mergeable aggregates per entity, period and arrival day. A
delivery routes its records by their watermarks, reads the state of the months that it hits, upserts the changed keys,
emits their new aggregates, and puts late records and expired ones into tables beside the state, in one commit. Months
that the store's watermark has passed are closed: they are no longer read unless a delivery out of order hits them. As
the cut-off bounds the arrival days of a period, a key has at most ``allowed + 1`` rows whatever the number of its
records, and records are added up before the shuffle.

Defined cases: a null event time or arrival time belongs to no period (status null, left out); an arrival before the
event counts as on time; null values add nothing to sums; a volume beyond 64 bits is null; ties in event time are settled by the largest ``row_id``;
deliveries may come in any order and end in the same state; a delivery whose tag the last commit has changes nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.functions.scalars import norm_ticker
from tickforge.operators.tables import VersionedTable
from tickforge.workspace import replace_columns

#: Hours between event and arrival after which a record changes no period.
ALLOWED_LATENESS_HOURS = 168


def routed(df: DataFrame, event: str = "event_ts", arrival: str = "ingest_ts", allowed_hours: int = ALLOWED_LATENESS_HOURS) -> DataFrame:
    """Add ``period`` (the UTC day of the event), ``as_of_date`` (the day on which the record changes its period) and
    ``status``: on_time, late or expired. Rows without event or arrival time are left out."""
    e, a = F.col(f"`{event}`"), F.col(f"`{arrival}`")
    period = F.window(e, "1 day").start.cast("date")
    watermark = a - F.make_interval(hours=F.lit(allowed_hours))
    status = F.when(e < watermark, "expired").when(F.to_date(a) > F.to_date(e), "late").otherwise("on_time")
    kept = df.where(e.isNotNull() & a.isNotNull())
    return replace_columns(kept, period=period, as_of_date=F.greatest(F.to_date(e), F.to_date(a)), status=status)


def partial_state(df: DataFrame) -> DataFrame:
    """Mergeable state of ``routed`` records: one row per ticker, period and arrival day."""
    last = F.struct("event_ts", "row_id", "close")
    return (
        df.where(F.col("status") != "expired")
        .groupBy(norm_ticker(F.col("ticker")).alias("ticker"), "period", "as_of_date")
        .agg(
            F.count("*").alias("messages"),
            F.count_if(F.col("status") == "late").alias("late_messages"),
            F.try_sum("volume").alias("volume"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max(last).alias("last_quote"),
        )
    )


_MERGE = {"messages": F.sum, "late_messages": F.sum, "volume": F.try_sum, "high": F.max, "low": F.min, "last_quote": F.max}


def as_of_log(state: DataFrame) -> DataFrame:
    """The change log of a state: for each ticker and period, the whole aggregate as of each day on which it changed. The
    row with the largest ``as_of_date`` is the final one; upserting rows in the order of ``as_of_date`` ends in the same
    table."""
    w = Window.partitionBy("ticker", "period").orderBy("as_of_date").rowsBetween(Window.unboundedPreceding, 0)
    final = Window.partitionBy("ticker", "period")
    out = state.select("ticker", "period", "as_of_date", *[f(c).over(w).alias(c) for c, f in _MERGE.items()], (F.col("as_of_date") == F.max("as_of_date").over(final)).alias("is_final"))
    return out.withColumn("close", F.col("last_quote.close")).drop("last_quote")


def daily_as_of(df: DataFrame, **options) -> DataFrame:
    """``as_of_log`` of a whole table at once, without a store."""
    return as_of_log(partial_state(routed(df, **options)))


LATE_ROW = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("ticker", T.StringType()), T.StructField("period", T.DateType()), T.StructField("as_of_date", T.DateType()), T.StructField("hours_late", T.DoubleType()), T.StructField("status", T.StringType())])


class PeriodStore:
    """State, late rows, expired rows and emitted changes of a feed whose messages come once each."""

    def __init__(self, spark: SparkSession, path: str, allowed_hours: int = ALLOWED_LATENESS_HOURS):
        self.spark, self.allowed = spark, allowed_hours
        self.table = VersionedTable(spark, path)

    def deliver(self, arrivals: DataFrame, tag: str | None = None) -> DataFrame:
        """Take a delivery in; returns the new aggregates of the changed keys, from the first day on that changed."""
        rows = routed(arrivals, allowed_hours=self.allowed)
        fresh = partial_state(rows).withColumn("month", F.date_format("period", "yyyy-MM"))
        if not self.table.exists():
            self.table.create(T.StructType([T.StructField(f.name, f.dataType, True) for f in fresh.schema]), partition_by="month")
        base = self.table.manifest()
        version = base["version"] + 1
        if tag is not None and base["metrics"].get("tag") == tag:
            return self._changes(base["version"])
        # set apart the rows that correct a period or come too late, and the highest arrival
        hours = (F.unix_micros(F.col("ingest_ts").cast("timestamp")) - F.unix_micros(F.col("event_ts").cast("timestamp"))) / 3.6e9
        apart = rows.where("status <> 'on_time'").select(F.col("row_id").cast("long").alias("row_id"), norm_ticker(F.col("ticker")).alias("ticker"), "period", "as_of_date", hours.alias("hours_late"), "status")
        apart_files = self.table._write(apart, "status")
        fresh_files = self.table._write(fresh, "month")  # its folders tell which months are hit
        hit = sorted(fresh_files.keys() & base["parts"].keys())
        state = self.table._open(fresh_files, self.table.schema)
        changed = state.groupBy("ticker", "period").agg(F.min("as_of_date").alias("since"))
        if hit:
            both = self.table.read(base["version"], hit).unionByName(state)
            merged = both.groupBy("ticker", "period", "as_of_date", "month").agg(*[f(c).alias(c) for c, f in _MERGE.items()])
            files = self.table._write(merged.select(state.columns), "month")
            state = self.table._open(files, self.table.schema)
        else:
            files = fresh_files
        key = F.col("ticker").eqNullSafe(F.col("c_ticker")) & (F.col("period") == F.col("c_period"))
        keys = changed.select(F.col("ticker").alias("c_ticker"), F.col("period").alias("c_period"), "since")
        emitted = as_of_log(state).join(keys, key & (F.col("as_of_date") >= F.col("since"))).drop("c_ticker", "c_period", "since").withColumn("version", F.lit(version))
        last = arrivals.agg(F.max("ingest_ts")).first()[0]
        watermark = max(filter(None, [base["metrics"].get("watermark"), (last - dt.timedelta(hours=self.allowed)).isoformat() if last else None]), default=None)
        months = sorted({*base["parts"], *files})
        closed = [m for m in months if watermark and m < watermark[:7]]
        metrics = {"watermark": watermark, "hitMonths": len(fresh_files), "openMonths": len(months) - len(closed), "closedMonths": len(closed)} | ({"tag": tag} if tag is not None else {})
        self.table.put(base, "DELIVER", metrics, added=files, dropped=hit, side={"apart": (apart_files, ()), "changes": ({f"v{version}": self.table._write(emitted, None)["__all__"]}, ())})
        return self._changes(version)

    def _changes(self, version: int) -> DataFrame:
        kinds = {"messages": "BIGINT", "late_messages": "BIGINT", "volume": "BIGINT", "high": "DOUBLE", "low": "DOUBLE", "is_final": "BOOLEAN", "close": "DOUBLE", "version": "INT"}
        schema = T.StructType([T.StructField(n, T.DateType() if n in ("period", "as_of_date") else T.StringType()) for n in ("ticker", "period", "as_of_date")]).simpleString()[7:-1]
        schema = T._parse_datatype_string(", ".join([schema, *[f"{n} {t}" for n, t in kinds.items()]]))
        return self.table.read_side("changes", schema, [f"v{version}"])

    def state(self) -> DataFrame:
        return self.table.read()

    def log(self) -> DataFrame:
        return as_of_log(self.state())

    def current(self) -> DataFrame:
        """The upserted table: the latest aggregate per ticker and period."""
        return self.log().where("is_final").drop("is_final")

    def apart(self, *statuses: str) -> DataFrame:
        """Rows that corrected a period (late) and rows that came too late (expired)."""
        return self.table.read_side("apart", LATE_ROW, list(statuses) or None)


def late_rows(kept: DataFrame, path: str, days: int = 30, allowed_hours: int = ALLOWED_LATENESS_HOURS) -> DataFrame:
    """row_id, status of the records that correct a period or come too late for it, as a fresh ``PeriodStore`` at ``path``
    sets them apart: all arrivals but those of the last ``days`` are one delivery, these the next."""
    return feed(kept, path, days, allowed_hours).apart().select("row_id", "status")


def feed(kept: DataFrame, path: str, days: int = 30, allowed_hours: int = ALLOWED_LATENESS_HOURS) -> PeriodStore:
    store = PeriodStore(kept.sparkSession, path, allowed_hours)
    last = kept.agg(F.max("ingest_ts")).first()[0]
    early = F.lit(True) if last is None else F.coalesce(F.col("ingest_ts") < F.lit(last - dt.timedelta(days=days)), F.lit(True))
    store.deliver(kept.where(early))
    store.deliver(kept.where(~early))
    return store


def expired_report(apart: DataFrame) -> DataFrame:
    """Diverted records by ticker and period, from the rows that a store set apart."""
    return apart.where("status = 'expired'").groupBy("ticker", "period").agg(F.count("*").alias("dropped"), F.max("hours_late").alias("max_hours_late"))
