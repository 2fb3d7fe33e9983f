"""Places that all executors share: cut lineage with a written table, never with a machine-local folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session without the setting whose tasks all run on this machine (tests,
    notebooks) gets a local one; on a cluster each executor would write to a disk of its own, so there it is an error."""
    root = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(CHECKPOINT_SETTING)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_SETTING} must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tickforge-')}"
        spark.conf.set(CHECKPOINT_SETTING, root)
    return root.rstrip("/")


_made: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. ``release`` removes it."""
    _made.append(f"{shared_root(spark)}/tickforge/{name}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def release(spark: SparkSession) -> int:
    """Remove all that this process has put into the shared folder; for use when no result is read any more."""
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), len(_made)
    while _made:
        at = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        at.getFileSystem(conf).delete(at, True)
    return n


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality on all ``keys`` in which null agrees with null; it stays an equi-join."""
    cond = left[keys[0]].eqNullSafe(right[keys[0]])
    for k in keys[1:]:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def replace_columns(df: DataFrame, **new: Column) -> DataFrame:
    """Add operator columns; an input column with the name of an operator column gives way to it."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new], *[v.alias(k) for k, v in new.items()])
