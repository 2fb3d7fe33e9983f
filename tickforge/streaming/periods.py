"""Late events as a stream: micro-batches of arrivals go through the store of messages, which drops copies, and then into
the keyed state of periods, which upserts changed periods, emits them, and diverts what is below the watermark.

Both stores commit a micro-batch under its number, so one that is tried again changes nothing. The stores keep their own
watermark, from the arrival of each record; the order of files is the order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.operators.late import PeriodStore
from tickforge.operators.redelivery import MessageStore


def run_periods(spark: SparkSession, source: str, root: str, schema, files_per_batch: int = 1) -> tuple[MessageStore, PeriodStore]:
    messages, periods = MessageStore(spark, f"{root}/messages"), PeriodStore(spark, f"{root}/periods")

    def update(batch: DataFrame, batch_id: int) -> None:
        surplus = messages.deliver(batch, tag=str(batch_id)).withColumnRenamed("row_id", "__surplus")
        once = batch.join(surplus, F.col("row_id") == F.col("__surplus"), "left_anti")
        periods.deliver(once, tag=str(batch_id))

    stream = spark.readStream.option("maxFilesPerTrigger", files_per_batch).schema(schema).parquet(source)
    stream.writeStream.foreachBatch(update).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return messages, periods


def replay(feed: DataFrame, root: str, batches: int = 3) -> PeriodStore:
    """Lay a feed down as files in the order of arrival and stream them: one micro-batch per file set. Rows of equal
    arrival stay together; rows without arrival come first."""
    spark = feed.sparkSession
    at = F.unix_micros(F.col("ingest_ts").cast("timestamp"))
    bounds = feed.select(F.percentile_approx(at, [k / batches for k in range(1, batches)], 10000)).first()[0] or []
    part = F.lit(0)
    for b in bounds:
        part = part + F.coalesce((at > b).cast("int"), F.lit(0))
    for k in range(batches):
        feed.where(part == k).coalesce(1).write.mode("append").parquet(f"{root}/arrivals")
    return run_periods(spark, f"{root}/arrivals", root, feed.schema)[1]
