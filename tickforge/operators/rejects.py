"""Rows that fail to parse: the valid rows load, the others come out with one reason.

Both loaders take the same steps, per Arrow batch: (1) the CSV reader takes the lines with every field as a string, and
its invalid-row callback hands over the lines whose structure isn't the declared one; (2) whole columns of strings are
tested and cast at once; (3) failing cells are labelled, and the first failing one in contract order is the row's reason.

``parse_delimited`` loads lines of delimited text against a declared schema; there the reader alone decides on structure.
A quotation that is left open makes the reader run on into the lines after it, which shows, as each line starts with a
mark: the line that ran on is the reject, and those it swallowed are read again.

``parse_quotes`` loads JSON quote payloads against the quote contract. A payload with the ten keys in contract order and
plain scalars is a line of ten cells for the reader, whatever its spacing. What the callback hands over, and lines with a
cell that isn't ``"key": plain scalar``, are payloads of another structure: only those are decoded one by one, which tells
MALFORMED_JSON and payloads that are no object from keys that are missing, undeclared, repeated or in another order. The
contract's reading is lax: numbers may be strings, whole floats are integers, booleans are numbers, dates may carry a
midnight time or be epoch numbers. Not-a-number and infinities follow Python's JSON reader.

Defined cases: a null payload is MALFORMED_JSON; repeated keys keep the last value; a key's case counts; empty and very
long payloads are ordinary; an accepted volume beyond 64 bits loads as null; event_ts loads as a UTC time, null if absent;
an empty table gives no row; an input column with the name of an output column gives way.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator
from datetime import date, datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The contract's field order, reason codes and symbol pattern.
FIELD_ORDER = ("ticker", "trade_date", "open", "high", "low", "close", "adj_close", "volume", "source", "event_ts")
REASONS = (
    "MALFORMED_JSON",
    "MISSING_FIELD",
    "INVALID_TICKER",
    "INVALID_TIMESTAMP",
    "NON_POSITIVE_PRICE",
    "NEGATIVE_VOLUME",
    "OHLC_INCONSISTENT",
    "WRONG_TYPE",
    "FUTURE_DATED",
    "UNKNOWN",
)
SYMBOL = r"^[A-Z]{1,6}([.\-][A-Z]{1,2})?$"

#: Cell kinds: absent, null, string, number (int or float), boolean, anything else.
_ABSENT, _NULL, _STR, _INT, _FLOAT, _BOOL, _NESTED = "a", "z", "s", "i", "f", "b", "o"


# -- step 1: structure ------------------------------------------------------------------------------------------


def _read_strings(lines: bytes, columns: list[str], delimiter: str, quote: str | bool = '"') -> tuple[pa.Table, list[str]]:
    """All fields as strings, and the texts of the lines that the reader refused."""
    rejects: list[str] = []

    def invalid(row: pacsv.InvalidRow) -> str:
        rejects.append(row.text)
        return "skip"

    table = pacsv.read_csv(
        io.BytesIO(lines),
        read_options=pacsv.ReadOptions(column_names=columns, use_threads=False, block_size=max(1 << 20, len(lines) + 1)),
        parse_options=pacsv.ParseOptions(delimiter=delimiter, quote_char=quote, double_quote=bool(quote), newlines_in_values=bool(quote), invalid_row_handler=invalid, ignore_empty_lines=True),
        convert_options=pacsv.ConvertOptions(column_types={c: pa.string() for c in columns}, strings_can_be_null=False, quoted_strings_can_be_null=False, check_utf8=False),
    )
    return table, rejects


def _digits(v: int) -> str:
    try:
        return str(v)
    except ValueError:  # beyond the interpreter's digit limit: any huge number behaves alike
        return "9" * 400 if v > 0 else "-" + "9" * 400


def _whole_text(s: str) -> bool:
    """No half of a surrogate pair, which is no text."""
    return s.isascii() or not any("\ud800" <= c <= "\udfff" for c in s)


def _cell(v) -> tuple[str, str]:
    if v is None:
        return _NULL, ""
    if isinstance(v, str):
        return (_STR, v) if _whole_text(v) else (_NESTED, "")
    if isinstance(v, bool):
        return _BOOL, "1" if v else "0"
    if isinstance(v, int):
        return _INT, _digits(v)
    if isinstance(v, float):
        return _FLOAT, repr(v)
    return _NESTED, ""


def _decode(payload: str | None) -> str | list[tuple[str, str]]:
    """A reason, or the ten cells and the reason for undeclared keys ('' if there are none)."""
    try:
        if payload is None:
            raise ValueError("no payload")
        o = json.loads(payload)
    except (ValueError, RecursionError):
        return "MALFORMED_JSON"
    if not isinstance(o, dict):
        return "WRONG_TYPE"
    undeclared = o.keys() - set(FIELD_ORDER)
    return [*[_cell(o[f]) if f in o else (_ABSENT, "") for f in FIELD_ORDER], ("", "" if not undeclared else "WRONG_TYPE" if all(map(_whole_text, undeclared)) else "UNKNOWN")]


_SCALAR = r'(?P<v>"[^"\\\x00-\x1f]*"|-?(?:0|[1-9][0-9]{0,17})(?:\.[0-9]{1,40})?|true|false|null)'
_CELLS = [rf'^{"[ ]*[{]" if i == 0 else ""}[ ]*"{f}"[ ]*:[ ]*{_SCALAR}[ ]*{"[}][ ]*" if i == len(FIELD_ORDER) - 1 else ""}$' for i, f in enumerate(FIELD_ORDER)]


def _cells_of(payloads: pa.Array) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, pa.Array]], np.ndarray]:
    """Reason by structure ('' for objects), kind and text of each field, and the reason for undeclared keys."""
    n = len(payloads)
    lines = pc.fill_null(payloads, "")
    one_line = ~_matches(lines, r"[\r\n\x00]") & payloads.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(one_line)
    plain = np.zeros(0, np.int64)
    columns: list[pa.Array] = []
    if at.size:
        numbered = pc.binary_join_element_wise(pa.array(at.astype(str).tolist(), pa.string()), lines.take(pa.array(at)), ",")
        table, _ = _read_strings(("\n".join(numbered.to_pylist()) + "\n").encode(), ["__i", *FIELD_ORDER], ",", False)  # the refused lines are those that stay out of ``plain``
        where = pc.cast(table["__i"], pa.int64()).to_numpy()
        found = [_flat(pc.struct_field(pc.extract_regex(table[f], p), [0])) for f, p in zip(FIELD_ORDER, _CELLS)]
        whole = np.ones(len(where), bool)
        for c in found:
            whole &= c.is_valid().to_numpy(zero_copy_only=False)
        plain, take = where[whole], pa.array(np.flatnonzero(whole))
        columns = [c.take(take) for c in found]
    reason, extra = np.full(n, "", "U20"), np.full(n, "", "U20")
    odd = np.setdiff1d(np.arange(n), plain)
    decoded = []
    for i in odd.tolist():
        got = _decode(payloads[i].as_py())
        if isinstance(got, str):
            reason[i] = got
            got = [(_ABSENT, "")] * len(FIELD_ORDER) + [("", "")]
        extra[i] = got[-1][1]
        decoded.append(got)
    order = pa.array(np.argsort(np.concatenate([plain, odd]), kind="stable"))
    cells = {}
    for k, f in enumerate(FIELD_ORDER):
        raw = columns[k] if columns else pa.array([], pa.string())
        lead = pc.utf8_slice_codeunits(raw, 0, 1).to_numpy(zero_copy_only=False).astype("U1")
        kind = np.where(lead == '"', _STR, np.where(lead == "n", _NULL, np.where((lead == "t") | (lead == "f"), _BOOL, np.where(_matches(raw, r"\."), _FLOAT, _INT)))).astype("U1")
        text = pc.if_else(pa.array(lead == '"'), pc.utf8_slice_codeunits(raw, 1, -1), pc.if_else(pa.array(lead == "t"), "1", pc.if_else(pa.array(lead == "f"), "0", pc.if_else(pa.array(lead == "n"), "", raw))))
        kinds = np.concatenate([kind, np.array([d[k][0] for d in decoded], "U1")])
        texts = pa.concat_arrays([_flat(text), pa.array([d[k][1] for d in decoded], pa.string())])
        cells[f] = (kinds[order.to_numpy()], texts.take(order))
    return reason, cells, extra


# -- step 2: vector casts ---------------------------------------------------------------------------------------

_FLOAT_TEXT = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_FLOAT_WORD = r"(?i)^[+-]?(?:inf|infinity|nan)$"
_BAD_UNDERSCORE = r"^_|_$|__"
_INT_TEXT = r"^[+-]?[0-9]+(?:_[0-9]+)*(?:\.0+)?$"
_DATE_TEXT = r"^(?P<y>[0-9]{4})-(?P<m>[0-9]{2})-(?P<d>[0-9]{2})$"
_TIME_TEXT = r"^(?P<y>[0-9]{4})-(?P<m>[0-9]{2})-(?P<d>[0-9]{2})[Tt _](?P<h>[0-9]{2}):(?P<n>[0-9]{2})(?::(?P<s>[0-9]{2})(?:[.,](?P<f>[0-9]+))?)?(?P<z>Z|z|[+-][0-9]{2}:?[0-9]{2})?$"
DAY_US = 86_400_000_000


def _flat(a) -> pa.Array:
    if isinstance(a, pa.ChunkedArray):
        return pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    return a


def _matches(text, pattern: str) -> np.ndarray:
    return _flat(pc.match_substring_regex(text, pattern)).to_numpy(zero_copy_only=False).astype(bool)


def _cast(text: pa.Array, ok: np.ndarray, kind: pa.DataType, fill: str = "0") -> np.ndarray:
    return pc.cast(pc.if_else(pa.array(ok), text, fill), kind).to_numpy(zero_copy_only=False)


def _floats(kind: np.ndarray, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(is a number by the lax reading, its value)."""
    text = pc.if_else(pa.array(kind == _STR), pc.utf8_trim_whitespace(text), text)
    scalar = np.isin(kind, (_STR, _INT, _FLOAT, _BOOL)) & ~_matches(text, _BAD_UNDERSCORE)
    text = pc.replace_substring(text, "_", "")
    word = scalar & _matches(text, _FLOAT_WORD)
    plain = scalar & _matches(text, _FLOAT_TEXT)
    value = _cast(pc.replace_substring_regex(text, r"^\+", ""), plain, pa.float64()).copy()
    if word.any():
        low = pc.utf8_lower(text).to_numpy(zero_copy_only=False)
        value[word] = [float(s) for s in low[word]]
    return word | plain, value


def _ints(kind: np.ndarray, text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(is an integer by the lax reading, its value as float for the sign, its value as BIGINT: null if it doesn't fit)."""
    is_str = kind == _STR
    text = pc.if_else(pa.array(is_str), pc.utf8_trim_whitespace(text), text)
    whole = np.isin(kind, (_INT, _BOOL)) | (is_str & _matches(text, _INT_TEXT))
    ok_f, value = _floats(kind, text)
    with np.errstate(invalid="ignore"):
        whole_float = (kind == _FLOAT) & ok_f & (np.abs(value) < 2.0**63) & (np.floor(value) == value)
    digits = pc.replace_substring_regex(pc.replace_substring(pc.replace_substring_regex(text, r"\.0*$", ""), "_", ""), r"^\+?0*([0-9])", r"\1")
    short = whole & _matches(digits, r"^-?[0-9]{1,18}$")
    exact = _cast(digits, short, pa.int64()).copy()
    fits = short | whole_float
    exact[whole_float] = value[whole_float].astype(np.int64)
    for i in np.flatnonzero(whole & ~short).tolist():
        v = int(digits[i].as_py()) if len(digits[i].as_py()) < 4000 else 1 << 64
        if -(2**63) <= v < 2**63:
            exact[i], fits[i] = v, True
    return whole | whole_float, value, pa.array(exact, pa.int64(), mask=~fits)


def _civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is a day of the calendar, days since 1970)."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    month = np.where(ok, (y - 1970) * 12 + m - 1, 0)
    first, after = month.astype("M8[M]").astype("M8[D]").astype(np.int64), (month + 1).astype("M8[M]").astype("M8[D]").astype(np.int64)
    ok &= d <= after - first
    return ok, np.where(ok, first + d - 1, 0)


def _groups(text: pa.Array, pattern: str) -> dict[str, pa.Array]:
    got = _flat(pc.extract_regex(text, pattern))
    return {f.name: pc.fill_null(got.field(i), "") for i, f in enumerate(got.type)}


def _number(text: pa.Array) -> np.ndarray:
    return _cast(text, ~pc.equal(text, "").to_numpy(zero_copy_only=False).astype(bool), pa.int64())


def _times(kind: np.ndarray, text: pa.Array, any_time: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is a date, or with ``any_time`` a point in time, by the lax reading; microseconds since 1970). Numbers are
    seconds, or milliseconds beyond 2e10, also as strings. As dates, times must be at midnight."""
    number = np.isin(kind, (_INT, _FLOAT)) | ((kind == _STR) & _matches(text, _FLOAT_TEXT))
    value = _cast(pc.replace_substring_regex(text, r"^\+", ""), number & _matches(text, _FLOAT_TEXT), pa.float64())
    with np.errstate(invalid="ignore", over="ignore"):
        s = np.where(np.abs(value) > 2e10, value / 1000, value)
        ok = number & _matches(text, _FLOAT_TEXT) & np.isfinite(s) & (s >= -62135596800) & (s < 253402300800)
        us = np.where(ok, np.rint(np.where(ok, s, 0) * 1e6), 0).astype(np.int64)
    is_str = kind == _STR
    plain, timed = is_str & _matches(text, _DATE_TEXT), is_str & _matches(text, _TIME_TEXT)
    if plain.any():
        g = _groups(text, _DATE_TEXT)
        good, days = _civil(*[_number(g[c]) for c in "ymd"])
        ok, us = np.where(plain, good, ok), np.where(plain, days * DAY_US, us)
    if timed.any():
        g = _groups(text, _TIME_TEXT)
        good, days = _civil(*[_number(g[c]) for c in "ymd"])
        h, n, sec = (_number(g[c]) for c in "hns")
        part = _number(pc.utf8_slice_codeunits(pc.utf8_rpad(g["f"], 6, "0"), 0, 6))
        zone = pc.replace_substring(g["z"], ":", "")
        zoned = pc.greater(pc.utf8_length(zone), 1).to_numpy(zero_copy_only=False).astype(bool)
        off = lambda a, z: _cast(pc.utf8_slice_codeunits(zone, a, z), zoned, pa.int64())
        oh, om = off(1, 3), off(3, 5)
        sign = np.where(pc.starts_with(zone, "-").to_numpy(zero_copy_only=False).astype(bool), -1, 1)
        good &= (h <= 23) & (n <= 59) & (sec <= 59) & (oh <= 23) & (om <= 59)
        local = (h * 3600 + n * 60 + sec) * 1_000_000 + part
        if not any_time:
            good &= local == 0
            oh = om = np.zeros_like(oh)
        ok, us = np.where(timed, good, ok), np.where(timed, days * DAY_US + local - sign * (oh * 3600 + om * 60) * 1_000_000, us)
    if not any_time:
        ok = ok & (us % DAY_US == 0)
    return ok, np.where(ok, us, 0)


# -- step 3: labels ---------------------------------------------------------------------------------------------


def _symbols(text: pa.Array) -> pa.Array:
    """Stripped and in upper case; letters that become several ones are left to the interpreter."""
    out = pc.utf8_upper(pc.utf8_trim_whitespace(text))
    wide = ~pc.string_is_ascii(out).to_numpy(zero_copy_only=False).astype(bool)
    if wide.any():
        full = out.to_pylist()
        for i in np.flatnonzero(wide).tolist():
            full[i] = text[i].as_py().strip().upper()
        out = pa.array(full, pa.string())
    return out


def _label(reason: np.ndarray, cells: dict[str, tuple[np.ndarray, pa.Array]], extra: np.ndarray, today: int) -> dict[str, pa.Array]:
    """Completes ``reason`` ('' for accepted) and returns the typed columns."""
    n = len(reason)
    first = lambda mask, code: np.putmask(reason, mask & (reason == ""), code)
    typed: dict[str, pa.Array] = {}
    price: dict[str, np.ndarray] = {}
    for f in FIELD_ORDER:
        kind, text = cells[f]
        absent = kind == _ABSENT
        if f == "ticker":
            first(absent, "MISSING_FIELD")
            symbol = _symbols(text)
            first((kind != _STR) | ~_matches(symbol, SYMBOL.replace("$", r"\z")), "INVALID_TICKER")
            typed[f] = symbol
        elif f == "trade_date":
            first(absent, "MISSING_FIELD")
            ok, us = _times(kind, text, False)
            days = us // DAY_US
            first(~ok, "INVALID_TIMESTAMP")
            first(days > today, "FUTURE_DATED")
            typed[f] = pa.array(days.astype(np.int32), mask=~ok).cast(pa.date32())
        elif f == "volume":
            first(absent, "MISSING_FIELD")
            ok, v, exact = _ints(kind, text)
            first(~ok, "WRONG_TYPE")
            first(v < 0, "NEGATIVE_VOLUME")
            typed[f] = exact
        elif f == "source":
            first(~np.isin(kind, (_STR, _ABSENT)), "UNKNOWN")
            typed[f] = pc.if_else(pa.array(kind == _STR), pc.utf8_trim_whitespace(text), pa.scalar(None, pa.string()))
        elif f == "event_ts":
            ok, us = _times(kind, text, True)
            first(~ok & ~absent, "UNKNOWN")
            typed[f] = pa.array(us, pa.int64(), mask=~ok).cast(pa.timestamp("us"))
        else:
            free = f == "adj_close"
            skip = absent | (kind == _NULL) if free else np.zeros(n, bool)
            if not free:
                first(absent, "MISSING_FIELD")
            ok, v = _floats(kind, text)
            first(~ok & ~skip, "WRONG_TYPE")
            first(~(v > 0) & ~skip, "NON_POSITIVE_PRICE")
            price[f] = v
            typed[f] = pa.array(v, mask=~ok)
    for code in ("WRONG_TYPE", "UNKNOWN"):
        first(extra == code, code)
    top, bottom = np.maximum(price["open"], price["close"]), np.minimum(price["open"], price["close"])
    first((price["high"] < price["low"]) | (price["high"] < top) | (price["low"] > bottom), "OHLC_INCONSISTENT")
    return typed


_TYPED = T.StructType(
    [
        T.StructField("ticker", T.StringType()), T.StructField("trade_date", T.DateType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adj_close")],
        T.StructField("volume", T.LongType()), T.StructField("source", T.StringType()), T.StructField("event_ts", T.TimestampNTZType()),
    ]
)


def judge_payloads(payloads: pa.Array | list[str | None], today: int) -> tuple[list[str | None], dict[str, pa.Array]]:
    """Reason (None: accepted) and typed columns of each payload, in order."""
    reason, cells, extra = _cells_of(_flat(payloads) if isinstance(payloads, (pa.Array, pa.ChunkedArray)) else pa.array(payloads, pa.string()))
    typed = _label(reason, cells, extra, today)
    good = reason == ""
    return [r or None for r in reason.tolist()], {c: pc.if_else(pa.array(good), a, pa.scalar(None, a.type)) for c, a in typed.items()}


def parse_quotes(df: DataFrame, payload: str = "raw_payload", today: date | None = None) -> DataFrame:
    """Input columns, the ten typed columns in a struct ``quote`` (null for rejects) and ``reason`` (null for accepted).

    ``today``: the last admissible trade_date; the UTC day of the call unless given."""
    limit = (today or datetime.now(timezone.utc).date()).toordinal() - 719163
    keep = [f for f in df.schema if f.name not in ("quote", "reason")]
    schema = T.StructType([*keep, T.StructField("quote", _TYPED), T.StructField("reason", T.StringType())])
    names = [f.name for f in keep]
    src = df.select(*[F.col(f"`{n}`") for n in names])
    at = names.index(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reason, typed = judge_payloads(b.column(at), limit)
            ok = pa.array([r is not None for r in reason])
            quote = pa.StructArray.from_arrays([typed[c] for c in FIELD_ORDER], FIELD_ORDER, mask=ok)
            yield pa.RecordBatch.from_arrays([*b.columns, quote, pa.array(reason, pa.string())], [*names, "quote", "reason"])

    return src.mapInArrow(run, schema)


def accepted(parsed: DataFrame, id_cols: list[str]) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).select(*[F.col(f"`{c}`") for c in id_cols], "quote.*")


def rejected(parsed: DataFrame, id_cols: list[str]) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select(*[F.col(f"`{c}`") for c in id_cols], "reason")


# -- delimited text ---------------------------------------------------------------------------------------------

_CASTS = {"double": (_FLOAT_TEXT, pa.float64(), T.DoubleType()), "bigint": (r"^[+-]?[0-9]{1,40}$", pa.int64(), T.LongType()), "string": (None, pa.string(), T.StringType()), "date": (_DATE_TEXT, pa.date32(), T.DateType())}


def _split_lines(raw: list[str | None], columns: list[str], delimiter: str) -> tuple[list[str | None], np.ndarray, dict[str, pa.Array]]:
    """Reason by structure of each line, and of the whole ones their numbers and their fields."""
    mark = uuid.uuid4().hex  # no line holds it
    find = re.compile(mark + r"(\d+)" + re.escape(delimiter))
    names = ["__i", *columns]
    reason: list[str | None] = ["COLUMN_COUNT" if s is None or not s.strip() else None for s in raw]
    pending = [i for i, r in enumerate(reason) if r is None]
    alone = [[i] for i in pending if "\n" in raw[i] or "\r" in raw[i]]  # what they hold may look like several lines
    rounds = [[i for i in pending if "\n" not in raw[i] and "\r" not in raw[i]], *alone]
    tables = []
    while rounds:
        lines = rounds.pop()
        if not lines:
            continue
        # the last line closes a quotation that is still open
        sent = "\n".join([f"{mark}{i}{delimiter}{raw[i]}" for i in lines] + [f'{mark}"', ""])
        table, refused = _read_strings(sent.encode("utf-8", "replace"), names, delimiter)
        again: list[int] = []
        seen: set[int] = set()
        for text in refused:
            at = [int(x) for x in find.findall(text)]
            for i in at[:1]:
                reason[i] = "BROKEN_QUOTING" if text.count(mark) > 1 else "COLUMN_COUNT"
                seen.add(i)
            again += at[1:]
        ran_on = np.zeros(table.num_rows, bool)
        for c in columns:
            ran_on |= _matches(table[c], mark)
        for k in np.flatnonzero(ran_on).tolist():
            reason[int(table["__i"][k].as_py()[len(mark) :])] = "BROKEN_QUOTING"
            again += [int(x) for c in columns for x in find.findall(table[c][k].as_py())]
        first = _flat(table["__i"])
        own = _matches(first, f"^{mark}[0-9]+$") & ~ran_on
        if len(lines) == 1 and (table.num_rows + len(refused) > 2 or own.sum() != 1):  # one line came out as several
            reason[lines[0]] = reason[lines[0]] or "COLUMN_COUNT"
            continue
        tables.append(table.filter(pa.array(own)))
        rounds.append(again)
    whole = pa.concat_tables(tables) if tables else pa.table({c: pa.array([], pa.string()) for c in names})
    where = pc.cast(pc.utf8_slice_codeunits(whole["__i"], len(mark)), pa.int64()).to_numpy()
    return reason, where, {c: _flat(whole[c]) for c in columns}


def parse_delimited(df: DataFrame, line: str, columns: dict[str, str], delimiter: str = ",", required: tuple[str, ...] = ()) -> DataFrame:
    """Lines of delimited text against ``columns`` (name -> string, double, bigint or date).

    Result: input columns, struct ``record`` and ``reason``: COLUMN_COUNT (the reader finds another number of fields),
    BROKEN_QUOTING (a quotation is left open), INVALID_VALUE:<column> or MISSING_VALUE:<column> for the first failing
    cell. A quote inside an unquoted field is a character like others. An empty cell is null. A null or blank line is
    COLUMN_COUNT; a line break is part of a field only inside quotes; a whole number beyond 64 bits is INVALID_VALUE."""
    names = [f.name for f in df.schema if f.name not in ("record", "reason")]
    record = T.StructType([T.StructField(c, _CASTS[t][2]) for c, t in columns.items()])
    schema = T.StructType([*[f for f in df.schema if f.name in names], T.StructField("record", record), T.StructField("reason", T.StringType())])
    at = names.index(line)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(at).to_pylist()
            reason, where, fields = _split_lines(raw, list(columns), delimiter)
            label = np.full(len(where), "", dtype=object)
            typed = []
            for c, t in columns.items():
                text = fields[c]
                empty = pc.equal(text, "").to_numpy(zero_copy_only=False).astype(bool)
                if c in required:
                    label[empty & (label == "")] = f"MISSING_VALUE:{c}"
                pattern, to, _ = _CASTS[t]
                ok = ~empty
                value = None
                if pattern:
                    ok &= _matches(text, pattern)
                    if t == "date":
                        g = _groups(text, pattern)
                        good, days = _civil(*[_number(g[x]) for x in "ymd"])
                        ok &= good
                        value = pa.array(days.astype(np.int32), mask=~ok).cast(to)
                    elif t == "bigint":
                        _, _, value = _ints(np.full(len(text), _STR), text)
                        ok &= value.is_valid().to_numpy(zero_copy_only=False)
                    label[~ok & ~empty & (label == "")] = f"INVALID_VALUE:{c}"
                typed.append(pc.if_else(pa.array(ok), value if value is not None else pc.cast(pc.if_else(pa.array(ok), text, pa.scalar(None, pa.string())), to), pa.scalar(None, to)))
            for i, r in zip(where.tolist(), label.tolist()):
                reason[i] = reason[i] or r or None
            place = np.full(len(raw), -1, np.int64)
            place[where] = np.arange(len(where))
            bad_rows = np.array([r is not None for r in reason], bool)
            take = pa.array(np.where(place >= 0, place, 0), mask=(place < 0) | bad_rows)
            rec = pa.StructArray.from_arrays([a.take(take) for a in typed], list(columns), mask=pa.array(bad_rows))
            yield pa.RecordBatch.from_arrays([*b.columns, rec, pa.array(reason, pa.string())], [*names, "record", "reason"])

    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)
