"""Lineage events of runs, kept as JSON lines, sent to a collector, or both. Recording never breaks the run that it records."""

from __future__ import annotations

import contextlib
import json
import logging
import urllib.request
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
SCHEMA = "eventType STRING, eventTime STRING, runId STRING, job STRING, parentRunId STRING, inputs ARRAY<STRING>, outputs ARRAY<STRING>, error STRING, metrics MAP<STRING,STRING>"


def run_id(given: str | None) -> str:
    """A UUID stays as it is, another string gives its own fixed UUID, nothing gives a new one."""
    if not given:
        return str(uuid.uuid4())
    try:
        return str(uuid.UUID(given))
    except ValueError:
        return str(uuid.uuid5(uuid.NAMESPACE_URL, given))


class Recorder:
    """``path``: a file of events; ``url``: where each event is posted. Either may be None."""

    def __init__(self, path: str | None, parent: str | None = None, url: str | None = None, timeout: float = 5.0):
        self.path, self.parent, self.url, self.timeout = path, run_id(parent) if parent else None, url, timeout

    def emit(self, **event) -> None:
        line = json.dumps({"eventTime": datetime.now(timezone.utc).isoformat(), "parentRunId": self.parent} | event, default=str)
        try:
            if self.path:
                Path(self.path).parent.mkdir(parents=True, exist_ok=True)
                with open(self.path, "a", encoding="utf-8") as f:
                    f.write(line + "\n")
        except OSError:
            log.warning("lineage event not recorded", exc_info=True)
        try:
            if self.url:
                urllib.request.urlopen(urllib.request.Request(self.url, line.encode(), {"Content-Type": "application/json"}), timeout=self.timeout).close()
        except (OSError, ValueError):
            log.warning("lineage event not sent", exc_info=True)

    @contextlib.contextmanager
    def run(self, job: str, inputs: tuple[str, ...] = (), outputs: tuple[str, ...] = ()) -> Iterator[dict]:
        """START, then COMPLETE with the metrics that the body puts into the dict, or FAIL and the error again."""
        base, metrics = {"job": job, "runId": run_id(None), "inputs": list(inputs), "outputs": list(outputs)}, {}
        self.emit(eventType="START", **base)
        try:
            yield metrics
        except BaseException as e:
            self.emit(eventType="FAIL", error=repr(e)[:500], **base)
            raise
        self.emit(eventType="COMPLETE", metrics={k: str(v) for k, v in metrics.items()}, **base)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


STATES = ("START", "COMPLETE", "FAIL")


def summary(events: DataFrame, job: str = "job", state: str = "eventType", states: tuple[str, ...] = STATES) -> DataFrame:
    """Jobs by state: one column per state."""
    return events.groupBy(job).pivot(state, list(states)).agg(F.count(F.lit(1))).na.fill(0)


def by_state(events: DataFrame, state: str = "eventType") -> DataFrame:
    return events.groupBy(F.col(state).alias("state")).agg(F.count("*").alias("events"))


def topic_counts(messages: DataFrame, topic: str = "topic", partition: str = "partition", offset: str = "offset") -> DataFrame:
    """Messages per topic as a broker counts them: the high less the low water mark of each partition."""
    marks = messages.groupBy(F.col(topic).alias("topic"), F.col(partition)).agg(F.min(offset).alias("lo"), (F.max(offset) + 1).alias("hi"))
    return marks.groupBy("topic").agg(F.sum(F.col("hi") - F.col("lo")).alias("messages"))
