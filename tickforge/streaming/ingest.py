"""A bounded stream of messages through the contract into landing, quarantine and dead-letter files.

A topic is a folder of Parquet files in the schema ``TOPIC``: keyed messages with headers, as a broker gives them.
``foreachBatch`` judges a micro-batch with the contract's full reading and writes its outcomes under the micro-batch's
number, so that a repeated one overwrites what its first attempt wrote; the checkpoint is committed after all of them.
``availableNow`` drains what is there and ends. A blank message is a message: it is MALFORMED_JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.operators.contract import verdicts
from tickforge.operators.rejects import parse_quotes
from tickforge.operators.tables import _Files

_HEADERS = "ARRAY<STRUCT<key: STRING, value: BINARY>>"
TOPIC = f"key STRING, value STRING, headers {_HEADERS}, topic STRING, partition INT, offset BIGINT"
QUARANTINE = (
    "raw_payload STRING, reason STRING, details ARRAY<STRUCT<field: STRING, reason: STRING, message: STRING, received: STRING>>, rejected_at TIMESTAMP,"
    " kafka STRUCT<topic: STRING, partition: INT, offset: BIGINT, key: STRING>, audit MAP<STRING, STRING>"
)
#: Partitions by key of the two topics, and how long they keep messages.
TOPIC_PLAN = {"quotes": {"partitions": 3, "retention_days": 7}, "quotes.dead-letter": {"partitions": 1, "retention_days": 30}}
#: Characters of a received value that a rejection quotes.
RECEIVED_CHARS = 200
MESSAGES = {
    "MALFORMED_JSON": "is no JSON", "MISSING_FIELD": "is missing", "INVALID_TICKER": "is no symbol", "INVALID_TIMESTAMP": "is no date", "NON_POSITIVE_PRICE": "is not above 0", "NEGATIVE_VOLUME": "is below 0",
    "OHLC_INCONSISTENT": "high and low don't enclose the other prices", "WRONG_TYPE": "has the wrong type or isn't declared", "FUTURE_DATED": "lies after today", "UNKNOWN": "is not valid",
}


def headers_of(tags: dict[str, Column]) -> Column:
    """Headers from text values; null ones are left out."""
    return F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), F.encode(v, "UTF-8").alias("value"))) for k, v in tags.items()]))


def decoded(headers: Column) -> Column:
    """Headers as a map of texts: of equal keys the last one counts, bytes that are no text are replaced."""
    keys = F.array_distinct(F.transform(headers, lambda h: h["key"]))
    text = lambda k: F.try_validate_utf8(F.element_at(F.filter(headers, lambda h: h["key"] == k), -1)["value"].cast("string"))
    return F.coalesce(F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(text(k), F.lit("�")))), F.create_map().cast("map<string,string>"))


def produce(payloads: DataFrame, path: str, topic: str = "quotes", key: str = "ticker", order: str = "trade_date", tags: dict[str, Column] | None = None) -> None:
    """Write ``payloads`` (raw_payload) as a topic: messages of one key are in one partition, in order."""
    n = TOPIC_PLAN.get(topic, {"partitions": 1})["partitions"]
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")
    rows = payloads.select(F.col(key).cast("string").alias("key"), F.col("raw_payload").alias("value"), headers_of(tags or {}).cast(_HEADERS).alias("headers"), F.lit(topic).alias("topic"), part.alias("partition"), F.col(order).alias("__o"))
    rows = rows.repartition(n, "partition").sortWithinPartitions("partition", "__o", "key", "value").withColumn("offset", F.monotonically_increasing_id() % F.lit(1 << 33))
    rows.select("key", "value", "headers", "topic", "partition", "offset").write.mode("overwrite").parquet(path)


def judged(messages: DataFrame) -> DataFrame:
    """``raw_payload``, ``reason`` and what the envelope takes of messages in the schema ``TOPIC``."""
    m = messages.select(F.col("value").alias("raw_payload"), F.struct("topic", "partition", "offset", "key").alias("kafka"), decoded(F.col("headers")).alias("audit"))
    return parse_quotes(m).drop("quote")


def envelopes(rejects: DataFrame) -> DataFrame:
    """Rejected messages in the schema ``QUARANTINE``: the primary reason first, then what else the contract finds."""
    v = verdicts(rejects.withColumnRenamed("reason", "__primary"))
    received = lambda f: F.substring(F.when(f.startswith("<"), F.col("raw_payload")).otherwise(F.try_variant_get(F.try_parse_json("raw_payload"), F.concat(F.lit("$."), f), "string")), 1, RECEIVED_CHARS)
    message = lambda r: F.element_at(F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv]), r)
    found = F.transform(F.filter("violations", lambda x: x["reason"].isNotNull()), lambda x: F.struct(x["field"].alias("field"), x["reason"].alias("reason"), message(x["reason"]).alias("message"), received(x["field"]).alias("received")))
    primary = F.col("__primary")
    first = F.struct(F.lit("<record>").alias("field"), primary.alias("reason"), message(primary).alias("message"), F.substring("raw_payload", 1, RECEIVED_CHARS).alias("received"))
    # the chain of Column expressions knows a narrower form of the contract; where it finds another reason, the record's stands first
    details = F.when(F.get(found, F.lit(0))["reason"] == primary, found).otherwise(F.concat(F.array(first), found))
    return v.select("raw_payload", primary.alias("reason"), details.alias("details"), F.current_timestamp().alias("rejected_at"), "kafka", "audit")


def run_ingest(spark: SparkSession, source: str, root: str, files_per_batch: int = 4, reset_landing: bool = True) -> None:
    """Drain the topic at ``source``: ``root``/landing gets accepted payloads, ``root``/quarantine the envelopes of rejects and
    ``root``/dead_letter the same as messages of the dead-letter topic. ``reset_landing`` starts from the beginning."""
    if reset_landing:
        files = _Files(spark, root)
        for part in ("landing", "quarantine", "dead_letter", "checkpoint"):
            files.fs.delete(files.path(f"{root}/{part}"), True)

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = judged(batch).persist()
        try:
            rows.where("reason IS NULL").select("raw_payload").write.mode("overwrite").parquet(f"{root}/landing/batch={batch_id}")
            bad = envelopes(rows.where("reason IS NOT NULL"))
            bad.write.mode("overwrite").json(f"{root}/quarantine/batch={batch_id}")
            name = "quotes.dead-letter"
            letter = bad.select(F.col("kafka.key").alias("key"), F.to_json(F.struct("*")).alias("value"), headers_of({"reason": F.col("reason")}).alias("headers"), F.lit(name).alias("topic"), F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"))
            letter.write.mode("overwrite").parquet(f"{root}/dead_letter/batch={batch_id}")
        finally:
            rows.unpersist()

    messages = spark.readStream.option("maxFilesPerTrigger", files_per_batch).schema(TOPIC).parquet(source)
    messages.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(QUARANTINE).json(f"{root}/quarantine/*")


def read_landing(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("raw_payload STRING").parquet(f"{root}/landing/*")


def drain_payloads(payloads: DataFrame, root: str, key: str = "ticker", order: str = "trade_date") -> DataFrame:
    """Produce payloads, stream them, and count outcomes: outcome, n."""
    spark = payloads.sparkSession
    produce(payloads, f"{root}/topic", key=key, order=order)
    run_ingest(spark, f"{root}/topic", root)
    ok = read_landing(spark, root).select(F.lit("ACCEPTED").alias("outcome"))
    return ok.unionByName(read_quarantine(spark, root).select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


def kafka_source(spark: SparkSession, servers: str, topic: str, streaming: bool = True) -> DataFrame:
    """The same messages from a broker, where the connector is on the class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    raw = reader.option("startingOffsets", "earliest").option("includeHeaders", "true").load()
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "headers", "topic", "partition", "offset")
