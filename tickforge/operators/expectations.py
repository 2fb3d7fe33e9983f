"""Declarative expectations compiled into one aggregate pass, and the gate that stops a publication.

All row-level expectations of a suite become conditional counts of a single ``agg``; compound uniqueness needs one
grouped pass more. A null is unexpected only for a not-null expectation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.schemas import REQUIRED


@dataclass(frozen=True)
class Expectation:
    kind: str
    args: dict = field(default_factory=dict)
    why: str = ""

    @property
    def label(self) -> str:
        a = self.args
        names = [a[k] for k in ("column", "a", "b") if k in a] + list(a.get("columns", ()))
        return f"{self.kind}:" + ",".join(names)


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


#: kind -> Column that is true for an unexpected row. New kinds can be registered here.
ROW_KINDS: dict[str, Callable[[dict], Column]] = {
    "pair_at_least": lambda a: _q(a["a"]) < _q(a["b"]),
    "not_null": lambda a: _q(a["column"]).isNull(),
    "above": lambda a: _q(a["column"]) <= a["low"],
    "at_least": lambda a: _q(a["column"]) < a["low"],
    "in_set": lambda a: ~_q(a["column"]).isin(list(a["values"])),
}


def quote_suite(known_tickers: tuple[str, ...] = ()) -> list[Expectation]:
    pairs = [("high", "low"), ("high", "close"), ("close", "low"), ("high", "open"), ("open", "low")]
    suite = [Expectation("pair_at_least", {"a": a, "b": b}, "a bar contains its own prices") for a, b in pairs]
    suite += [Expectation("not_null", {"column": c}, "required") for c in REQUIRED]
    suite += [Expectation("above", {"column": c, "low": 0}, "a price is positive") for c in ("open", "high", "low", "close")]
    suite.append(Expectation("at_least", {"column": "volume", "low": 0}, "a volume isn't negative"))
    suite.append(Expectation("compound_unique", {"columns": ("ticker", "trade_date")}, "one bar per session"))
    suite.append(Expectation("row_count", {"low": 1}, "an empty table isn't published"))
    if known_tickers:
        suite.append(Expectation("in_set", {"column": "ticker", "values": tuple(known_tickers)}, "only followed tickers"))
    return suite


def duplicate_rows(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row: every member of a group with more than one row counts."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("n"))


def evaluate(df: DataFrame, suite: list[Expectation]) -> DataFrame:
    """One row per expectation: label, kind, element_count, unexpected_count, unexpected_percent, success."""
    row_level = [e for e in suite if e.kind in ROW_KINDS]
    counts = df.agg(F.count("*").alias("__n"), *[F.count_if(ROW_KINDS[e.kind](e.args)).alias(f"u{i}") for i, e in enumerate(row_level)])
    for j, e in enumerate(x for x in suite if x.kind == "compound_unique"):
        counts = counts.crossJoin(duplicate_rows(df, e.args["columns"]).withColumnRenamed("n", f"d{j}"))  # one row with one row
    n = F.col("__n")
    items, i, j = [], 0, 0
    for e in suite:
        if e.kind in ROW_KINDS:
            bad, i = F.col(f"u{i}"), i + 1
        elif e.kind == "compound_unique":
            bad, j = F.col(f"d{j}"), j + 1
        elif e.kind == "row_count":
            bad = F.when(n >= e.args["low"], 0).otherwise(1).cast("long")
        else:
            raise ValueError(f"unknown expectation {e.kind}")
        items.append(F.struct(F.lit(e.label).alias("label"), F.lit(e.kind).alias("kind"), bad.cast("long").alias("unexpected_count")))
    out = counts.select(n.alias("element_count"), F.explode(F.array(*items)).alias("e")).select("e.label", "e.kind", "element_count", "e.unexpected_count")
    return out.withColumn("unexpected_percent", F.when(F.col("element_count") > 0, F.col("unexpected_count") / F.col("element_count") * 100)).withColumn("success", F.col("unexpected_count") == 0)


def summarise(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("evaluated"), F.count_if("success").alias("successful"), F.min("success").alias("success"), F.max("element_count").alias("rows"))


def failed_details(df: DataFrame, suite: list[Expectation], results: list[dict], most: int = 20) -> list[dict]:
    """For each failed expectation its arguments and at most ``most`` of the unexpected values."""
    failed = {r["label"]: r for r in results if not r["success"]}
    out = []
    for e in suite:
        if e.label not in failed:
            continue
        names = [e.args[k] for k in ("column", "a", "b") if k in e.args] + list(e.args.get("columns", ()))
        if e.kind in ROW_KINDS:
            rows = df.where(ROW_KINDS[e.kind](e.args))
        elif e.kind == "compound_unique":
            rows = df.groupBy(*names).count().where("count > 1")
        else:
            rows = None
        values = [tuple(r) if len(names) > 1 else r[0] for r in rows.select(*names).orderBy(*names).limit(most).collect()] if rows is not None else []
        out.append({"label": e.label, "kwargs": dict(e.args), "why": e.why, **{k: failed[e.label][k] for k in ("unexpected_count", "unexpected_percent")}, "partial_unexpected_list": values})
    return out


class GateFailure(RuntimeError):
    """The data didn't meet the suite; the report is in ``report``."""

    def __init__(self, report: dict):
        super().__init__(f"{len(report['failed'])} of {report['evaluated']} expectations failed")
        self.report = report


def run_gate(df: DataFrame, suite: list[Expectation], write_report: Callable[[dict], None] | None = None, fail: bool = True) -> dict:
    """Evaluate, hand the report to ``write_report``, and only then raise if it failed."""
    rows = [r.asDict() for r in evaluate(df, suite).collect()]  # one row per expectation
    report = {"evaluated": len(rows), "successful": sum(r["success"] for r in rows), "success": all(r["success"] for r in rows), "failed": [r for r in rows if not r["success"]]}
    if report["failed"]:
        report["details"] = failed_details(df, suite, rows)
    if write_report:
        write_report(report)
    if fail and not report["success"]:
        raise GateFailure(report)
    return report


def taint(bars: DataFrame) -> DataFrame:
    """The bars and five bad rows: the three latest with high 1 and low 9999 (fixed values), the earliest without close,
    the latest again."""
    cols = bars.columns
    latest = bars.orderBy(F.col("trade_date").desc(), "ticker")
    swapped = latest.limit(3).withColumn("high", F.lit(1.0)).withColumn("low", F.lit(9999.0))
    hollow = bars.orderBy("trade_date", "ticker").limit(1).withColumn("close", F.lit(None).cast("double"))
    again = latest.limit(1)
    return bars.unionByName(swapped.select(cols)).unionByName(hollow.select(cols)).unionByName(again.select(cols))
