"""Messages delivered more than once: exactly one copy of each, also across batches.

``keep_first`` is the stateless core. ``MessageStore`` keeps a partitioned, versioned table of winners and, as a side of
the same table, an identifier index in buckets by hash. A delivery is merged by looking its identifiers up in the buckets
that they fall into, reading only the historical partitions that hold them, and recomputing single winners over both. One
commit replaces those partitions, adds the new messages to the others without rewriting them, and adds their index
entries: it is there as a whole or not at all.

Defined cases: null agrees with null in every identifier column; a null order value comes after all others; rows
equal in identifier and order values are told apart by nothing, and exactly one of them stays; an empty delivery is
an empty commit; extra columns are carried along. An identifier with a third of all rows is reduced by partial
aggregation before the shuffle, and the surplus is found by the row's own id, so that no task gets all its copies.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.functions.scalars import norm_ticker
from tickforge.operators.tables import VersionedTable
from tickforge.workspace import shared_path


def quote_identity() -> list[Column]:
    """What makes two quotes one message."""
    return [norm_ticker(F.col("ticker")), F.col("trade_date"), F.col("event_ts")]


def _order(order: list[str]) -> Column:
    """A struct that sorts by the order columns with nulls last."""
    return F.struct(*[x for c in order for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def keep_first(df: DataFrame, identity: list[Column] | None = None, order: tuple[str, ...] = ("ingest_ts", "row_id")) -> DataFrame:
    """One row per identity, the first by ``order``; all columns of ``df``, in their order."""
    ids = [c.alias(f"__id{i}") for i, c in enumerate(quote_identity() if identity is None else identity)]
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    won = df.select(*ids, _order(list(order)).alias("__o"), whole.alias("__row")).groupBy(*[f"__id{i}" for i in range(len(ids))]).agg(F.min_by("__row", "__o").alias("__row"))
    return won.select("__row.*")


INDEX = T.StructType([T.StructField("__hash", T.LongType()), T.StructField("__part", T.StringType()), T.StructField("__bucket", T.StringType())])


class MessageStore:
    """A table of winners, partitioned by the period in which a message first arrived, and an index identifier -> partition.

    A message stays in the partition in which it was first stored; a copy with an earlier arrival that is delivered
    later replaces the row in that partition. The index holds a hash of the identifier: a collision makes the store
    read one partition more and changes no result. A partition or bucket of more than ``MOST_FOLDERS`` folders is
    written anew when a delivery adds to it.
    """

    BUCKETS, MOST_FOLDERS = 16, 12

    def __init__(self, spark: SparkSession, path: str, identity: list[Column] | None = None, order: tuple[str, ...] = ("ingest_ts", "row_id"), row_id: str = "row_id", partition: Column | None = None):
        self.spark, self.path = spark, path
        self.identity = quote_identity() if identity is None else identity
        self.order, self.row_id = list(order), row_id
        self.partition = F.date_format("ingest_ts", "yyyy-MM") if partition is None else partition
        self.table = VersionedTable(spark, f"{path}/winners")

    def _keyed(self, df: DataFrame) -> DataFrame:
        cols = [c for c in df.columns if not c.startswith("__")]
        return df.select(*[F.col(f"`{c}`") for c in cols], F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in self.identity]).alias("__hash"))

    def _bucket(self) -> Column:
        return F.pmod("__hash", F.lit(self.BUCKETS)).cast("string")

    def deliver(self, incoming: DataFrame, tag: str | None = None) -> DataFrame:
        """Merge a delivery and commit. Returns ``row_id`` of each row that lost its place by it: surplus rows of the
        delivery and winners that the delivery displaced. A delivery whose ``tag`` the last commit has is not merged again."""
        new = self._keyed(incoming)
        base_cols = [c for c in new.columns if c != "__hash"]
        if not self.table.exists():
            own = [T.StructField("__part", T.StringType()), T.StructField("__since", T.IntegerType())]
            self.table.create(T.StructType([*[T.StructField(f.name, f.dataType, True) for f in new.schema], *own]), partition_by="__part")
        base = self.table.manifest()
        version, full = base["version"] + 1, lambda parts: [p for p, dirs in parts.items() if len(dirs) > self.MOST_FOLDERS]
        fresh = new.withColumn("__part", F.coalesce(self.partition, F.lit("none"))).withColumn("__since", F.lit(version))
        if tag is not None and base["metrics"].get("tag") == tag:
            return fresh.select(F.col(f"`{self.row_id}`")).join(self.table.read(version - 1).select(F.col(f"`{self.row_id}`")), self.row_id, "left_anti")
        hit: list[str] = []
        index = base.get("side", {}).get("index", {})
        if index:
            # names of buckets and of partitions, of which there is one per period
            buckets = [r[0] for r in new.select(self._bucket()).distinct().collect()]
            known = self.table.read_side("index", INDEX, buckets, base["version"])
            hit = sorted(r[0] for r in known.join(new.select("__hash").distinct(), "__hash", "left_semi").select("__part").distinct().collect())
        # a partition of many folders is read and replaced only if the delivery may add to it
        many = set(full(base["parts"])) - set(hit)
        if many:
            hit = sorted({*hit, *(r[0] for r in fresh.select("__part").distinct().where(F.col("__part").isin(sorted(many))).collect())})
        both = self.table.read(base["version"], hit).select(fresh.columns).unionByName(fresh) if hit else fresh
        ids = [c.alias(f"__id{i}") for i, c in enumerate(self.identity)]
        row = F.struct(*[F.col(f"`{c}`") for c in [*base_cols, "__hash"]])
        home = F.struct("__since", "__part")  # a stored message keeps its partition
        won = both.select(*ids, _order(self.order).alias("__o"), row.alias("__row"), home.alias("__h")).groupBy(*[f"__id{i}" for i in range(len(ids))]).agg(F.min_by("__row", "__o").alias("__row"), F.min("__h").alias("__h"))
        added = self.table._write(won.select("__row.*", "__h.__part", "__h.__since"), "__part")
        stored = self.table._open(added, self.table.schema)
        entries = stored.where(F.col("__since") == version).select("__hash", "__part", self._bucket().alias("__bucket"))
        crowded = full(index)
        if crowded:
            entries = entries.unionByName(self.table.read_side("index", INDEX, crowded, base["version"])).distinct()
        metrics = {"replacedPartitions": len(hit), "addedPartitions": len(added.keys() - set(hit)), "storedPartitions": len(base["parts"])} | ({"tag": tag} if tag is not None else {})
        self.table.put(base, "DELIVER", metrics, added=added, dropped=hit, side={"index": (self.table._write(entries, "__bucket"), crowded)})
        return both.select(F.col(f"`{self.row_id}`")).join(stored.select(F.col(f"`{self.row_id}`")), self.row_id, "left_anti")

    def winners(self) -> DataFrame:
        t = self.table.read()
        return t.select(*[F.col(f"`{c}`") for c in t.columns if c not in ("__hash", "__part", "__since")])


def surplus_rows(df: DataFrame, history_until: Column | None = None, path: str | None = None) -> DataFrame:
    """Every surplus ``row_id`` of a feed, through a fresh MessageStore: the rows for which ``history_until`` holds are
    loaded as history (default: all arrivals but those of the last 30 days), the others are delivered on top."""
    spark = df.sparkSession
    store = MessageStore(spark, path or shared_path(spark, f"messages-{uuid.uuid4().hex[:6]}"))
    if history_until is None:
        last = df.agg(F.max("ingest_ts")).first()[0]
        history_until = F.lit(True) if last is None else F.coalesce(F.col("ingest_ts") < F.lit(last) - F.expr("INTERVAL 30 DAYS"), F.lit(False))
    first = store.deliver(df.where(history_until))
    second = store.deliver(df.where(~history_until))
    return first.unionByName(second)
