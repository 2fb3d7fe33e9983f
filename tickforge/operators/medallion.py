"""The layers: raw lines, typed and deduplicated rows, per-ticker snapshots. Pure functions; ``run_*`` write tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge import schemas
from tickforge.functions.scalars import norm_ticker
from tickforge.operators.metrics import ticker_metrics
from tickforge.operators.redelivery import keep_first
from tickforge.operators.tables import VersionedTable, conform, merge_frames


def bronze_lines(lines: DataFrame, batch_id: str, at: Column | None = None) -> DataFrame:
    """``value`` and ``source_file`` to raw records; blank lines are dropped. ``payload_bytes`` counts characters, as
    downstream checks expect; ``payload_octets`` counts bytes."""
    now = F.current_timestamp() if at is None else at
    return lines.where(F.length(F.trim("value")) > 0).select(
        F.col("value").alias("raw_payload"), "source_file", F.length("value").alias("payload_bytes"), F.octet_length("value").alias("payload_octets"),
        now.alias("ingest_ts"), F.to_date(now).alias("ingest_date"), F.lit(batch_id).alias("batch_id"),
    )


def load_bronze(spark: SparkSession, lines: DataFrame, path: str, batch_id: str, at: Column | None = None) -> dict:
    """Append a batch of lines to the table of raw records. The table is partitioned by batch, so a batch that is loaded
    again takes its own place. A batch without lines is an error."""
    rows = _as_schema(conform(bronze_lines(lines, batch_id, at), schemas.BRONZE), schemas.BRONZE)
    table = VersionedTable(spark, path).create(schemas.BRONZE, partition_by="batch_id")
    base = table.manifest()
    added = table._write(rows, "batch_id")
    loaded = table._open(added, schemas.BRONZE)
    n = loaded.count()
    if not n:
        raise ValueError(f"batch {batch_id} has no lines")
    again = [p for p in base["parts"] if p == batch_id]
    table.put(base, "LOAD", {"batch": batch_id, "rows": n, "replaced": len(again)}, added=added, dropped=again)
    return {"batch_id": batch_id, "rows": n, "files": loaded.select("source_file").distinct().count(), "replaced": bool(again)}


def silver_parse(bronze: DataFrame) -> DataFrame:
    """Typed projection of raw payloads. What can't be read is null, never an error."""
    p = F.from_json("raw_payload", schemas.PAYLOAD)
    return bronze.select(p.alias("p"), "raw_payload", "ingest_ts", "batch_id").select(
        norm_ticker(F.col("p.ticker")).alias("ticker"), F.try_to_date(F.col("p.trade_date"), "yyyy-MM-dd").alias("trade_date"),
        *[F.col(f"p.{c}").alias(c) for c in ("open", "high", "low", "close", "adj_close", "volume", "source")],
        F.try_to_timestamp(F.col("p.event_ts")).alias("event_ts"), "ingest_ts", "batch_id", "raw_payload",
    )


def unparseable() -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in schemas.REQUIRED])


def silver_dedupe(parsed: DataFrame) -> DataFrame:
    """One row per ticker and trade_date: the latest event_ts (nulls last), then the latest ingest_ts, then the largest
    payload. The order is total, so the choice doesn't depend on the partitioning."""
    rank = F.struct(F.col("event_ts").isNotNull(), "event_ts", "ingest_ts", "raw_payload")
    row = F.struct(*[F.col(c) for c in parsed.columns])
    return parsed.groupBy("ticker", "trade_date").agg(F.max_by(row, rank).alias("r")).select("r.*")


def gold_guard(src, tgt) -> Column:
    """An older snapshot doesn't replace a newer one."""
    return src("as_of_date") >= tgt("as_of_date")


def merge_metrics(merged: DataFrame) -> DataFrame:
    """inserted, updated, kept, rows_before, rows_after of a merged frame."""
    n = lambda a: F.count_if(F.col("__action") == a)
    return merged.agg(n("insert").alias("inserted"), n("update").alias("updated"), n("keep").alias("kept"), (n("update") + n("keep") + n("delete")).alias("rows_before"), F.count_if(F.col("__action") != "delete").alias("rows_after"))


def run_silver(spark: SparkSession, bronze: DataFrame, path: str) -> dict:
    """Parse, set unreadable rows apart, deduplicate, upsert on (ticker, trade_date)."""
    parsed = silver_parse(bronze)
    good = silver_dedupe(parsed.where(~unparseable()))
    source = conform(good, schemas.SILVER)
    table = VersionedTable(spark, path).create(schemas.SILVER, partition_by="ticker", constraints=schemas.SILVER_CHECKS)
    bad = parsed.agg(F.count("*").alias("parsed"), F.count_if(unparseable()).alias("unparseable")).first().asDict()
    return bad | table.merge(_as_schema(source, schemas.SILVER), ["ticker", "trade_date"])


def run_gold(spark: SparkSession, silver: DataFrame, path: str) -> dict:
    """Snapshot every ticker and upsert it unless the table's snapshot is newer."""
    snap = ticker_metrics(silver).withColumn("updated_at", F.current_timestamp())
    table = VersionedTable(spark, path).create(schemas.GOLD)
    return table.merge(_as_schema(conform(snap, schemas.GOLD), schemas.GOLD), ["ticker"], guard=gold_guard)


def _as_schema(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


__all__ = ["bronze_lines", "silver_parse", "unparseable", "silver_dedupe", "gold_guard", "merge_metrics", "load_bronze", "run_silver", "run_gold", "merge_frames", "keep_first"]
