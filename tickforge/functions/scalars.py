"""Small Column builders shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the contract's symbol pattern, for use after trimming and upper-casing.
TICKER_PATTERN = r"^[A-Z]{1,6}([.\-][A-Z]{1,2})?\z"


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` only removes blanks)."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\s\x{00A0}]+", ""), r"[\s\x{00A0}]+\z", "")


def norm_ticker(c: Column) -> Column:
    return F.upper(strip(c))


def log_or_null(c: Column) -> Column:
    """Natural logarithm of positive values, else null."""
    return F.when(c > 0, F.ln(c))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def nvl_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))
