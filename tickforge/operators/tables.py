"""Versioned Parquet tables: atomic commits, strict schemas, stored constraints, guarded upserts, history, time travel.

A table is a folder with ``data/<commit>/...`` Parquet files and ``manifest/<version>.json``. A manifest names the
data folders that make up a version, one list per partition value, so that a commit may replace some partitions, add to
others and leave the rest where they are. A commit writes its data first and then creates the next manifest exclusively;
whoever loses that race gets ``CommitConflict`` and the table is as the winner left it. What belongs to a table but has
another schema (an index, diverted rows) is a side of it: files of its own, named in the same manifest and so committed
with it or not at all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALL = "__all__"


class CommitConflict(RuntimeError):
    """Another writer committed the same version first."""


class WriteRefused(ValueError):
    """The rows don't satisfy the table's schema or constraints; nothing was written."""


class _Files:
    """The few file-system calls that the manifests need, through Hadoop so that any shared store works."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, p: str) -> list[str]:
        at = self.path(p)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def create(self, p: str, text: str) -> bool:
        """Write a new file through a hidden one and an exclusive rename; False if it exists already."""
        at = self.path(p)
        if self.fs.exists(at):
            return False
        hidden = self.path(f"{p}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(hidden, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.conf).rename(
                hidden, at, self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
            )
            return True
        except Exception:
            self.fs.delete(hidden, False)
            return False

    def text(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), _Files(spark, path)

    # -- metadata -----------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/manifest") if n.endswith(".json"))

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> dict:
        have = self.versions()
        if not have:
            raise FileNotFoundError(f"no table at {self.path}")
        return json.loads(self.files.text(f"{self.path}/manifest/{have[-1] if version is None else version:010d}.json"))

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.manifest()["schema"])

    def history(self, limit: int | None = None) -> DataFrame:
        """Commits, newest first: version, timestamp, operation, operationMetrics map."""
        rows = [
            (m["version"], m["timestamp"], m["operation"], {k: str(v) for k, v in m["metrics"].items()})
            for m in (self.manifest(v) for v in self.versions()[::-1][:limit])
        ]
        return self.spark.createDataFrame(rows, "version BIGINT, timestamp STRING, operation STRING, operationMetrics MAP<STRING,STRING>")

    def create(self, schema: T.StructType, partition_by: str | None = None, constraints: dict[str, str] | None = None) -> VersionedTable:
        """Create unless it exists. ``constraints``: name -> SQL predicate. Not-null columns come from the schema."""
        if not self.exists():
            self._commit(0, "CREATE TABLE", {}, {}, schema, partition_by, constraints or {})
        return self

    def _commit(self, version, operation, metrics, parts, schema, partition_by, constraints, side=None) -> int:
        body = {
            "version": version, "timestamp": datetime.now(timezone.utc).isoformat(), "operation": operation, "metrics": metrics,
            "schema": json.loads(schema.json()), "partition_by": partition_by, "constraints": constraints, "parts": parts, "side": side or {},
        }
        if not self.files.create(f"{self.path}/manifest/{version:010d}.json", json.dumps(body)):
            raise CommitConflict(f"version {version} of {self.path} exists already")
        return version

    # -- reading ------------------------------------------------------------------------------------------------

    def read(self, version: int | None = None, partitions: list[str] | None = None) -> DataFrame:
        """A snapshot; with ``partitions`` only the files of those partition values are opened."""
        m = self.manifest(version)
        schema = T.StructType.fromJson(m["schema"])
        # what is in a partition's folder doesn't repeat the partition column in its path
        return self._open(m["parts"], schema, partitions)

    def _open(self, parts: dict[str, list[str]], schema: T.StructType, partitions: list[str] | None = None) -> DataFrame:
        dirs = sorted({d for p, ds in parts.items() if partitions is None or p in partitions for d in ds})
        if not dirs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(_nullable(schema)).parquet(*[f"{self.path}/data/{d}" for d in dirs])

    def read_side(self, name: str, schema: T.StructType, partitions: list[str] | None = None, version: int | None = None) -> DataFrame:
        return self._open(self.manifest(version).get("side", {}).get(name, {}), schema, partitions)

    # -- writing ------------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame, partition_by: str | None, rebalance: bool = True) -> dict[str, list[str]]:
        """``rebalance=False``: the rows of a partition stand together already."""
        commit = uuid.uuid4().hex[:16]
        if partition_by is None:
            df.write.option("compression", "zstd").parquet(f"{self.path}/data/{commit}")
            return {ALL: [commit]}
        key = F.coalesce(F.col(f"`{partition_by}`").cast("string"), F.lit("__null__"))
        # rebalance puts a partition's rows together and splits those that are too large for one task
        df = df.withColumn("__p", key)
        (df.hint("rebalance", F.col("__p")) if rebalance else df).write.option("compression", "zstd").partitionBy("__p").parquet(f"{self.path}/data/{commit}")
        unescape = self.files.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return {unescape(n[4:]): [f"{commit}/{n}"] for n in self.files.names(f"{self.path}/data/{commit}") if n.startswith("__p=")}

    def check(self, df: DataFrame, unique: list[str] | None = None) -> None:
        """Raise WriteRefused unless columns, types, not-null columns and constraints all hold, and no two rows have the
        same ``unique`` columns. One pass over ``df``."""
        m = self.manifest()
        schema = T.StructType.fromJson(m["schema"])
        want, got = {f.name: f for f in schema}, {f.name: f for f in df.schema}
        if extra := sorted(got.keys() - want.keys()):
            raise WriteRefused(f"unexpected columns: {extra}")
        if missing := sorted(want.keys() - got.keys()):
            raise WriteRefused(f"missing columns: {missing}")
        if wrong := [f"{n}: {got[n].dataType.simpleString()} is not {f.dataType.simpleString()}" for n, f in want.items() if got[n].dataType != f.dataType]:
            raise WriteRefused("wrong types: " + "; ".join(wrong))
        tests = violation_counts(schema, m["constraints"])
        if unique:
            some = {n: f"__v{i}" for i, n in enumerate(tests)}
            groups = df.groupBy(*[F.col(f"`{k}`") for k in unique]).agg(F.count("*").alias("__n"), *[c.alias(some[n]) for n, c in tests.items()])
            row = groups.agg(F.max("__n").alias("__n"), *[F.coalesce(F.sum(v), F.lit(0)).alias(n) for n, v in some.items()]).first()
            if (row["__n"] or 0) > 1:
                raise WriteRefused(f"several rows have the same {unique}")
        elif tests:
            row = df.agg(*[c.alias(n) for n, c in tests.items()]).first()
        if tests:
            if broken := [f"{n} ({row[n]} rows)" for n in tests if row[n]]:
                raise WriteRefused("violated: " + ", ".join(broken))

    def append(self, df: DataFrame, operation: str = "WRITE") -> int:
        self.check(df)
        m = self.manifest()
        new = self._write(df.select([f["name"] for f in m["schema"]["fields"]]), m["partition_by"])
        return self.put(m, operation, {}, added=new)

    def replace(self, df: DataFrame, partitions: list[str] | None, operation: str, metrics: dict, base: dict | None = None) -> int:
        """Atomically put ``df`` in the place of ``partitions`` (None: of everything). Others aren't touched."""
        m = base or self.manifest()
        new = self._write(df.select([f["name"] for f in m["schema"]["fields"]]), m["partition_by"])
        if clash := sorted(p for p in new if partitions is not None and p in m["parts"] and p not in partitions):
            raise ValueError(f"rows for partitions that aren't replaced: {clash[:5]}")
        return self.put(m, operation, metrics, added=new, dropped=partitions)

    def put(self, base: dict, operation: str, metrics: dict, added: dict[str, list[str]], dropped: list[str] | None = (), side: dict[str, tuple[dict[str, list[str]], list[str] | None]] | None = None) -> int:
        """One commit on top of ``base``: of the table and of each side that is named, the folders of the ``dropped``
        partitions (None: of all) go and the ``added`` ones come. ``side``: name -> (added, dropped)."""

        def merged(old: dict, add: dict, drop) -> dict:
            kept = {} if drop is None else {p: d for p, d in old.items() if p not in set(drop)}
            return {p: kept.get(p, []) + add.get(p, []) for p in {*kept, *add}}

        sides = dict(base.get("side", {}))
        for name, (add, drop) in (side or {}).items():
            sides[name] = merged(sides.get(name, {}), add, drop)
        return self._commit(base["version"] + 1, operation, metrics, merged(base["parts"], added, dropped), T.StructType.fromJson(base["schema"]), base["partition_by"], base["constraints"], sides)

    def merge(self, source: DataFrame, keys: list[str], guard: Callable[[Callable, Callable], Column] | None = None, delete_unmatched: bool = False) -> dict:
        """Upsert ``source``; returns the metrics that the history holds too. Two source rows of one key are refused. Where
        the table is partitioned by a key, only the partitions that the source has rows for are read and replaced."""
        m = self.manifest()
        self.check(source, keys)
        by = m["partition_by"]
        hit = None
        if by in keys and not delete_unmatched:
            part = F.coalesce(F.col(f"`{by}`").cast("string"), F.lit("__null__"))
            hit = sorted({r[0] for r in source.select(part).distinct().collect()} & m["parts"].keys())  # names of partitions
        target = self.read(m["version"], hit)
        merged = merge_frames(target, source, keys, guard, delete_unmatched).where("__action <> 'delete'")
        new = self._write(merged.select(*[f["name"] for f in m["schema"]["fields"]], "__action"), by)
        # the files have the action beside the table's columns, so the counts cost no second join
        counts = {r["__action"]: r["count"] for r in self._open(new, T.StructType([T.StructField("__action", T.StringType())])).groupBy("__action").count().collect()}
        metrics = {"numInserted": counts.get("insert", 0), "numUpdated": counts.get("update", 0), "numKept": counts.get("keep", 0)}
        metrics["numDeleted"] = target.count() - metrics["numUpdated"] - metrics["numKept"] if delete_unmatched else 0
        if hit is not None:  # rows of partitions that aren't touched are counted from the footers of their files
            metrics["numKept"] += self.read(m["version"], sorted(m["parts"].keys() - set(hit))).count()
        self.put(m, "MERGE", metrics | {"partitionsReplaced": len(m["parts"] if hit is None else hit), "partitionsBefore": len(m["parts"])}, added=new, dropped=hit)
        return metrics


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def violation_counts(schema: T.StructType, constraints: dict[str, str]) -> dict[str, Column]:
    """For each not-null column and constraint an aggregate that counts the rows that break it. A predicate that is
    null counts as broken."""
    tests = {f"NOT NULL {f.name}": F.count_if(F.col(f"`{f.name}`").isNull()) for f in schema if not f.nullable}
    return tests | {n: F.count_if(~F.coalesce(F.expr(p), F.lit(False))) for n, p in constraints.items()}


def merge_frames(target: DataFrame, source: DataFrame, keys: list[str], guard=None, delete_unmatched: bool = False) -> DataFrame:
    """The rows after an upsert with ``__action`` insert, update, keep or delete. ``guard(src, tgt)`` gets two
    functions from a column name to a Column; a match that fails it keeps the target's row. Null keys never match,
    as in SQL's MERGE."""
    cols = target.columns
    t = target.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("t"))
    s = source.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("s"))
    on = reduce(lambda a, b: a & b, [F.col(f"t.`{k}`") == F.col(f"s.`{k}`") for k in keys])
    j = t.join(s, on, "full_outer")
    ok = F.coalesce(guard(lambda c: F.col(f"s.`{c}`"), lambda c: F.col(f"t.`{c}`")), F.lit(False)) if guard else F.lit(True)
    action = (
        F.when(F.col("t").isNull(), "insert")
        .when(F.col("s").isNull(), "delete" if delete_unmatched else "keep")
        .when(ok, "update")
        .otherwise("keep")
    )
    j = j.withColumn("__action", action)
    row = F.when(F.col("__action").isin("insert", "update"), F.col("s")).otherwise(F.col("t"))
    return j.select(row.alias("__row"), "__action").select("__row.*", "__action")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to ``schema``: columns in its order and types, extra ones dropped; a missing one is a ValueError."""
    if missing := [f.name for f in schema if f.name not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
