"""The quote contract inside the JVM, fault injection, and the scorecard that holds one against the other.

The verdict is a chain of Column expressions over the VARIANT form of a payload: presence and type come from
``schema_of_variant``, values from ``try_variant_get``. It covers what upstream producers send; for the full lax reading
of numbers and dates, down to epoch dates and repeated keys, use ``rejects.parse_quotes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.scalars import TICKER_PATTERN, strip

DECLARED = ("ticker", "trade_date", "open", "high", "low", "close", "adj_close", "volume", "source", "event_ts")

# Faults and the reason that each must be rejected with, in the order in which they are drawn.
FAULTS = {
    "negative_price": "NON_POSITIVE_PRICE",
    "zero_price": "NON_POSITIVE_PRICE",
    "missing_ticker": "MISSING_FIELD",
    "blank_ticker": "INVALID_TICKER",
    "missing_close": "MISSING_FIELD",
    "corrupt_timestamp": "INVALID_TIMESTAMP",
    "future_date": "FUTURE_DATED",
    "negative_volume": "NEGATIVE_VOLUME",
    "high_below_low": "OHLC_INCONSISTENT",
    "non_numeric_price": "WRONG_TYPE",
    "unexpected_field": "WRONG_TYPE",
    "truncated_json": "MALFORMED_JSON",
}
FAULT_RATE, FAULT_SEED = 0.08, 7


# -- payloads and faults ----------------------------------------------------------------------------------------


def _hex_number(c: Column, start: int) -> Column:
    return F.conv(F.substring(c, start, 8), 16, 10).cast("bigint")


def draw_faults(bars: DataFrame, rate: float = FAULT_RATE, seed: int = FAULT_SEED) -> DataFrame:
    """Add ``fault`` (null for most rows): drawn from a hash of the key, so equal under any partitioning."""
    h = F.md5(F.concat_ws("|", "ticker", F.col("trade_date").cast("string"), F.lit(str(seed))))
    which = F.element_at(F.array(*[F.lit(f) for f in FAULTS]), (_hex_number(h, 9) % len(FAULTS) + 1).cast("int"))
    return bars.withColumn("fault", F.when(_hex_number(h, 1) / F.lit(float(1 << 32)) < rate, which))


def _text(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def payloads(bars: DataFrame) -> DataFrame:
    """``raw_payload``: the bar as JSON, damaged as ``fault`` says; a bar without the column ``fault`` is left whole."""
    fault = F.col("fault") if "fault" in bars.columns else F.lit(None).cast("string")
    is_ = lambda name: F.coalesce(fault == name, F.lit(False))
    num = lambda c: F.round(c, 6).cast("string")
    h = F.md5(F.concat_ws("|", "ticker", F.col("trade_date").cast("string")))
    bad_dates = F.array(*[F.lit(x) for x in ("yesterday", "2019-02-29", "04.07.2022", "2022-07", "week 27")])
    high, low = F.col("high"), F.col("low")
    values = {
        "ticker": F.when(is_("missing_ticker"), F.lit(None)).when(is_("blank_ticker"), _text(F.lit("???"))).otherwise(_text(F.col("ticker"))),
        "trade_date": F.when(is_("corrupt_timestamp"), _text(F.element_at(bad_dates, (_hex_number(h, 17) % 5 + 1).cast("int"))))
        .when(is_("future_date"), _text(F.date_add(F.current_date(), 45).cast("string")))
        .otherwise(_text(F.col("trade_date").cast("string"))),
        "open": F.when(is_("zero_price"), F.lit("0.0")).otherwise(num(F.col("open"))),
        "high": F.when(is_("high_below_low"), F.when(high == low, num(low * 0.5)).otherwise(num(low))).otherwise(num(high)),
        "low": F.when(is_("high_below_low") & (high != low), num(high)).otherwise(num(low)),
        "close": F.when(is_("missing_close"), F.lit(None)).when(is_("non_numeric_price"), _text(F.lit("N/A"))).when(is_("negative_price"), num(-F.abs("close"))).otherwise(num(F.col("close"))),
        "adj_close": F.lit("null"),
        "volume": F.when(is_("negative_volume"), (-F.abs("volume")).cast("string")).otherwise(F.col("volume").cast("string")),
        "source": _text(F.lit("bars")),
        "event_ts": _text(F.concat(F.col("trade_date").cast("string"), F.lit("T21:00:00+00:00"))),
        "remark": F.when(is_("unexpected_field"), _text(F.lit("by hand"))),
    }
    cells = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in values.items()]
    whole = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*cells)), ","), F.lit("}"))
    cut = F.substring(whole, F.lit(1), F.greatest(F.lit(8), (F.length(whole) / 2).cast("int")))
    return bars.withColumn("raw_payload", F.when(is_("truncated_json"), cut).otherwise(whole))


# -- verdicts ---------------------------------------------------------------------------------------------------


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once: the optimiser doesn't copy a generated column into each place that uses it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _v(name: str, kind: str) -> Column:
    return F.expr(f"try_variant_get(__v, '$.{name}', '{kind}')")


def _kind(name: str) -> Column:
    return F.expr(f"schema_of_variant(variant_get(__v, '$.{name}', 'variant'))")


def _cells() -> Column:
    """Kind and value of each field of the column ``__v``."""
    kinds = [_kind(f).alias(f"k_{f}") for f in DECLARED]
    texts = [_v(f, "string").alias(f"s_{f}") for f in ("ticker", "trade_date", "event_ts")]
    numbers = [_v(f, "double").alias(f"n_{f}") for f in ("open", "high", "low", "close", "adj_close", "volume")]
    extra = F.array_size(F.array_except(F.json_object_keys("raw_payload"), F.array(*[F.lit(c) for c in DECLARED]))) > 0
    return F.struct(*kinds, *texts, *numbers, extra.alias("extra"))


def _field_violations() -> Column:
    """Array of (field, reason) over the column ``__f``, in contract order."""
    f_ = lambda n: F.col(f"__f.{n}")
    missing = lambda f: f_(f"k_{f}").isNull()
    checks: list[tuple[str, Column]] = []
    symbol = F.upper(strip(f_("s_ticker")))
    checks.append(("ticker", F.when(missing("ticker"), "MISSING_FIELD").when((f_("k_ticker") != "STRING") | ~F.coalesce(symbol.rlike(TICKER_PATTERN), F.lit(False)), "INVALID_TICKER")))
    day = f_("s_trade_date")
    date = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}(T00:00(:00(\.0+)?)?(Z|\+00:00)?)?\z"), F.try_to_date(F.substring(day, 1, 10), "yyyy-MM-dd"))
    checks.append(("trade_date", F.when(missing("trade_date"), "MISSING_FIELD").when(date.isNull(), "INVALID_TIMESTAMP").when(date > F.current_date(), "FUTURE_DATED")))
    for f in ("open", "high", "low", "close", "adj_close"):
        x = f_(f"n_{f}")
        bad = F.when(x.isNull(), "WRONG_TYPE").when(F.isnan(x) | (x <= 0), "NON_POSITIVE_PRICE")
        skip = missing(f) | (f_(f"k_{f}") == "VOID")
        checks.append((f, F.when(~skip, bad) if f == "adj_close" else F.when(missing(f), "MISSING_FIELD").otherwise(bad)))
    vol = f_("n_volume")
    checks.append(("volume", F.when(missing("volume"), "MISSING_FIELD").when(vol.isNull() | (vol != F.floor(vol)), "WRONG_TYPE").when(vol < 0, "NEGATIVE_VOLUME")))
    checks.append(("source", F.when(f_("k_source") != "STRING", "UNKNOWN")))
    checks.append(("event_ts", F.when(~missing("event_ts") & F.try_to_timestamp(f_("s_event_ts")).isNull(), "UNKNOWN")))
    checks.append(("<extra>", F.when(f_("extra"), "WRONG_TYPE")))
    return F.array_compact(F.array(*[F.when(r.isNotNull(), F.struct(F.lit(f).alias("field"), r.alias("reason"))) for f, r in checks]))


def verdicts(df: DataFrame) -> DataFrame:
    """Add ``violations`` and ``reason`` (the first one; null for admitted rows) to rows with a ``raw_payload``."""
    one = lambda r: F.array(F.struct(F.lit("<record>").alias("field"), F.lit(r).alias("reason")))
    parsed = _once(df, "__v", F.try_parse_json("raw_payload"))
    cells = _once(parsed, "__f", _cells())
    listed = _once(cells, "__l", _field_violations())
    o, h, lo, c = (F.col(f"__f.n_{f}") for f in ("open", "high", "low", "close"))
    crossed = (h < lo) | (h < F.greatest(o, c)) | (lo > F.least(o, c))
    all_of = (
        F.when(F.col("__v").isNull(), one("MALFORMED_JSON"))
        .when(~F.schema_of_variant("__v").startswith("OBJECT"), one("WRONG_TYPE"))
        .when((F.size("__l") == 0) & crossed, one("OHLC_INCONSISTENT"))
        .otherwise(F.col("__l"))
    )
    judged = _once(listed, "violations", all_of)
    return judged.withColumn("reason", F.get("violations", F.lit(0))["reason"]).drop("__v", "__f", "__l")


def reason_counts(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("rejected"))


def consumer_stats(judged: DataFrame) -> DataFrame:
    n, ok = F.count("*"), F.count_if(F.col("reason").isNull())
    return judged.agg(n.alias("consumed"), ok.alias("accepted"), (n - ok).alias("rejected"), F.round(ok / F.nullif(n, F.lit(0)), 4).alias("acceptance_rate"))


def scorecard(judged: DataFrame) -> DataFrame:
    """Per injected fault: injected, quarantined, escaped, catch_rate, misclassified."""
    expected = F.create_map(*[F.lit(x) for kv in FAULTS.items() for x in kv])
    faulty = judged.where(F.col("fault").isNotNull())
    injected = faulty.groupBy("fault").agg(F.count("*").alias("injected"))
    caught = faulty.where(F.col("reason").isNotNull()).groupBy("fault").agg(
        F.count("*").alias("caught"), F.count_if(F.col("reason") != F.element_at(expected, F.col("fault"))).alias("wrong")
    )
    j = injected.join(caught, "fault", "left")
    q = F.coalesce("caught", F.lit(0))
    return j.select("fault", "injected", q.alias("quarantined"), (F.col("injected") - q).alias("escaped"), F.round(q / F.col("injected"), 4).alias("catch_rate"), F.coalesce("wrong", F.lit(0)).alias("misclassified"))


def organic_rejections(judged: DataFrame) -> DataFrame:
    """Rejected rows that no fault was put into: reason, rejected."""
    return reason_counts(judged.where(F.col("fault").isNull()))


def scorecard_total(card: DataFrame) -> DataFrame:
    return card.agg(
        F.sum("injected").alias("injected"), F.sum("quarantined").alias("quarantined"), F.sum(F.greatest("escaped", F.lit(0))).alias("escaped"), F.sum("misclassified").alias("misclassified")
    ).withColumn("catch_rate", F.round(F.col("quarantined") / F.nullif(F.col("injected"), F.lit(0)), 4))
