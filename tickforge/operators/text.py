"""Markup removal, sectioning and chunking of filings.

Where a chunk ends depends on where it began, so chunks come from an Arrow stage. It scans a text for its breaks once and
then finds each chunk's end by binary search; a document's other columns go through the same stage, so nothing is joined
back. All else is Column expressions."""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sizes in characters.
CHUNK_CHARS, CHUNK_OVERLAP, MIN_CHUNK, MIN_SECTION = 1600, 250, 200, 500

# Headings of annual reports. False marks those that only end the section before them.
HEADINGS = [
    ("Item 1", "Business", r"item\s*1\s*[\.\:\-–—]?\s*business", True),
    ("Item 1A", "Risk Factors", r"item\s*1a\s*[\.\:\-–—]?\s*risk\s*factors", True),
    ("Item 2", "Properties", r"item\s*2\s*[\.\:\-–—]?\s*propert", False),
    ("Item 3", "Legal Proceedings", r"item\s*3\s*[\.\:\-–—]?\s*legal\s*proceedings", True),
    ("Item 7", "Management's Discussion and Analysis", r"item\s*7\s*[\.\:\-–—]?\s*management'?s?\s*discussion", True),
    ("Item 7A", "Quantitative and Qualitative Disclosures About Market Risk", r"item\s*7a\s*[\.\:\-–—]?\s*quantitative", True),
    ("Item 8", "Financial Statements and Supplementary Data", r"item\s*8\s*[\.\:\-–—]?\s*financial\s*statements", False),
]

#: The share of a chunk in which it may not end at a break.
_BODY = 0.6
_BLANK_LINE, _AFTER_SENTENCE = re.compile(r"(?=\n\n)"), re.compile(r"(?<=[.!?])\s+")


class Breaks:
    """The places of a text where a chunk ends well."""

    def __init__(self, text: str):
        self.size = len(text)
        self.blank = [m.start() for m in _BLANK_LINE.finditer(text)]
        gaps = [m.span() for m in _AFTER_SENTENCE.finditer(text)]
        self.gap_from, self.gap_to = [g[0] for g in gaps], [g[1] for g in gaps]

    def best(self, low: int, high: int) -> int:
        """The end of the last blank line within low..high, else of the last sentence's gap (as far as ``high``), else ``high``."""
        k = bisect_right(self.blank, high - 2) - 1
        if k >= 0 and self.blank[k] >= low:
            return self.blank[k] + 2
        k = bisect_left(self.gap_from, high) - 1
        # the full stop before a gap has to lie within the range too
        return min(self.gap_to[k], high) if k >= 0 and self.gap_from[k] > low else high


def cut(text: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, int]]:
    """Spans of at most ``size`` characters that cover ``text``. Each reaches ``overlap`` characters back into the one
    before, but begins at least one character after it, and ends at a break in its last two fifths if there is one."""
    breaks = Breaks(text)
    begins, ends = [0] if text else [], []
    for begin in begins:  # grows while it is walked
        limit = begin + size
        ends.append(breaks.size if limit >= breaks.size else breaks.best(begin + int(size * _BODY), limit))
        if ends[-1] < breaks.size:
            begins.append(max(begin + 1, ends[-1] - overlap))
    return list(zip(begins, ends))


def chunk_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the ``keep`` columns, chunk_index, char_start, char_end, body (stripped) of all spans, short ones too. A size or
    overlap of 0 stands for the default; null and empty texts have no span; repeated ids are documents of their own."""
    width, back = (x if x else default for x, default in ((size, CHUNK_CHARS), (overlap, CHUNK_OVERLAP)))
    carried = [id_col, *[c for c in keep if c != id_col]]
    kinds = {"chunk_index": pa.int32(), "char_start": pa.int32(), "char_end": pa.int32(), "body": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row: list[int] = []
            cells: dict[str, list] = {k: [] for k in kinds}
            for at, whole in enumerate(b.column(len(carried)).to_pylist()):
                for index, (begin, end) in enumerate(cut(whole or "", width, back)):
                    row.append(at)
                    for name, value in zip(kinds, (index, begin, end, whole[begin:end].strip())):
                        cells[name].append(value)
            of = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(of) for k in range(len(carried))], *[pa.array(cells[k], t) for k, t in kinds.items()]], [*carried, *kinds])

    src = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(text_col).alias("__t"))
    fields = [f for f in src.schema if f.name != "__t"]
    out = T.StructType([*fields, *[T.StructField(c, T.StringType() if c == "body" else T.IntegerType()) for c in kinds]])
    return src.where(F.col("__t").isNotNull()).mapInArrow(run, out)


def chunk_id(file: Column, item: Column, index: Column, body: Column) -> Column:
    """Content-addressed, so indexing the same text again changes nothing."""
    parts = [F.coalesce(file, F.lit("")), F.coalesce(item, F.lit("")), index.cast("string"), F.substring(body, 1, 200)]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def chunks(sections: DataFrame, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, min_chars: int = MIN_CHUNK) -> DataFrame:
    """Chunks of sections (doc_id, source_file, item, text and provenance) that are long enough; indexes count all spans."""
    own = ("chunk_index", "char_start", "char_end", "body", "chunk_id", "text")
    spans = chunk_spans(sections, size=size, overlap=overlap, keep=tuple(c for c in sections.columns if c not in own))
    return spans.where(F.length("body") >= min_chars).withColumn("chunk_id", chunk_id(F.col("source_file"), F.col("item"), F.col("chunk_index"), F.col("body")))


def citation_label(ticker: Column, company: Column, form: Column, year: Column, item: Column, title: Column) -> Column:
    full = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    who = F.coalesce(full(ticker), full(company), F.lit(""))
    return F.concat(who, F.lit(" "), F.coalesce(form, F.lit("")), F.lit(" "), F.coalesce(full(year), F.lit("n.d.")), F.lit(" · "), F.coalesce(item, F.lit("")), F.lit(" "), F.coalesce(title, F.lit("")))


# -- markup -----------------------------------------------------------------------------------------------------

_SKIPPED_PARTS = re.compile(r"<(?:TYPE|DESCRIPTION)>GRAPHIC.*?</DOCUMENT>|<XBRL>.*?</XBRL>", re.IGNORECASE | re.DOTALL)
_IS_PAGE = re.compile(r"<(?:html|body|div|table|p)\b", re.IGNORECASE)
#: What stands between the texts of a page: scripts and styles with their contents, comments, and tags.
_BETWEEN = re.compile(r"<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[!?/a-z][^>]*>", re.IGNORECASE | re.DOTALL)
_TYPEWRITER = {"\xa0": " ", "’": "'", "“": '"', "”": '"'}
_RUNS = ((re.compile(r"[ \t]+"), " "), (re.compile(r"\n\s*\n\s*\n+"), "\n\n"))


def plain_text(raw: str | None) -> str | None:
    """A submission as prose: graphics and XBRL out; of a page the texts between the tags, one per line, with entities
    resolved; quotes and blanks evened out. Text that is no page keeps its entities."""
    if raw is None:
        return None
    prose = _SKIPPED_PARTS.sub(" ", raw)
    if _IS_PAGE.search(prose):
        prose = "\n".join(html.unescape(part) for part in _BETWEEN.split(prose) if part)
    for sign, plain in _TYPEWRITER.items():
        prose = prose.replace(sign, plain)
    for run, one in _RUNS:
        prose = run.sub(one, prose)
    return prose.strip()


_ANY_HEADING = re.compile("|".join(f"(?P<h{k}>{h[2]})" for k, h in enumerate(HEADINGS)), re.IGNORECASE)


def sections_of(text: str | None) -> list[tuple[str, str, str]]:
    """(item, title, body) in text order. A heading counts where it stands last; a section goes on to the next heading that
    counts, wanted or not. Short and unwanted sections are left out."""
    where = {int(m.lastgroup[1:]): m.start() for m in _ANY_HEADING.finditer(text or "")}  # later ones overwrite
    out: list[tuple[str, str, str]] = []
    end = len(text or "")
    for k, begin in sorted(where.items(), key=lambda x: -x[1]):
        item, title, _, wanted = HEADINGS[k]
        body = text[begin:end].strip()
        if wanted and len(body) >= MIN_SECTION:
            out.insert(0, (item, title, body))
        end = begin
    return out


def _arrow_map(df: DataFrame, col: str, out: T.StructField, fn) -> DataFrame:
    keep = [f for f in df.schema if f.name != out.name]
    names = [f.name for f in keep]
    at = names.index(col)

    def run(batches):
        kind = None
        for b in batches:
            from pyspark.sql.pandas.types import to_arrow_type

            kind = kind or to_arrow_type(out.dataType)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fn(x) for x in b.column(at).to_pylist()], kind)], [*names, out.name])

    return df.select(*names).mapInArrow(run, T.StructType([*keep, out]))


def strip_markup(df: DataFrame, col: str, out: str = "plain") -> DataFrame:
    return _arrow_map(df, col, T.StructField(out, T.StringType()), plain_text)


def split_sections(df: DataFrame, col: str = "text") -> DataFrame:
    """All other columns, and one row per section: item, title, body."""
    kind = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("item", "title", "body")]))
    got = _arrow_map(df, col, T.StructField("__s", kind), lambda x: [dict(zip(("item", "title", "body"), s)) for s in sections_of(x)])
    keep = [c for c in df.columns if c not in (col, "item", "title", "body")]
    return got.select(*keep, F.explode("__s").alias("s")).select(*keep, "s.*")
