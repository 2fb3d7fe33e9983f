"""Subject areas of documents by label propagation over a verified similarity graph.

Documents are alike where they share subject-bearing phrases, so the graph is kept in its factored form: documents,
sentence types (a sentence without numbers and company name), and phrases of one to three words, joined by tables
document-sentence and sentence-phrase. No pair of documents is ever formed. One round of propagation carries labels
from documents to the phrases of their sentences and back:

1. documents -> phrases: of the occurrences of a phrase, the share that lies in documents of each subject. Seeds have
   all their subjects, so the first round counts in seeds only; the label sets found later may lack some, so later
   rounds count all occurrences, or what such a document lacks would pass for what it has. An edge to a phrase counts only
   if it is verified: one subject holds a clear majority of its occurrences and stands clear of the next; in the first
   round it also has its share of all occurrences in the corpus, as far as seeds go (``LIFT``), so that wording which is
   common everywhere and merely happens to stand in few seeds is none; and in later rounds the seeds that have the phrase
   don't speak against it (``VETO``). Wording that goes with any subject thereby drops out of the graph, for good where the
   seeds show it.
2. phrases -> sentences: a sentence takes the subject that its verified phrases agree on.
3. sentences -> documents: a document gets every subject of at least ``MIN_SENTENCES`` of its sentences.

Trusted seeds are clamped: their label sets are put back before each round and are part of the result. The first round
starts from the seeds alone; later rounds use all documents. Rounds go on until the number of labels changes by less than
``CONVERGED``, at most ``ROUNDS``. Documents keep as many subjects as they have.

Defined cases: a null, empty or contentless text has no subject beyond its seed labels; repeated texts get equal
subjects; seed labels of unknown documents or subjects that aren't in the list are passed through as given; rows with
the same id count as one document with all their sentences; long texts are used whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.workspace import written

MIN_SENTENCES = 3
ROUNDS, CONVERGED = 12, 0.02
#: A phrase is verified if its first subject has this share of its occurrences, and this much more than the second.
MAJORITY, MARGIN, MIN_OCCURRENCES = 0.6, 0.25, 2
#: Of the occurrences that a phrase would have in seeds if all its documents were as often seeds as others, the least share
#: for its subject. Occurrences in seeds from which on they can speak against a subject.
LIFT, VETO = 0.4, 2

_INVISIBLE = re.compile("[\xad\u200b\u200c\u200d\u2060\ufeff]+")
_BREAK = re.compile(r"(\w)[-‐‑][ \t]*\r?\n[ \t]*(?=\w)")
_PARAGRAPH = re.compile(r"\n[ \t\r\xa0]*\n")
_UNITS = re.compile(r"\b(mio|mrd|tsd|nr|no|vs|approx|bzw)\.", re.IGNORECASE)
_FIRMS = re.compile(r"\b(inc|corp|co|ltd)\.(?!\s+[A-ZÀ-Þ¿¡])", re.IGNORECASE)
_ENDS = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_HYPHEN = re.compile(r"(?<=\w)[-‐‑](?=\w)")
#: What is left of accents when letters are taken apart.
_ACCENTS = re.compile("[" + "".join(chr(c) for c in range(0x300, 0x1E95B) if unicodedata.combining(chr(c))) + "]+")


_LATIN_ACCENTS, _OTHER_SCRIPTS = re.compile("[\u0300-\u036f]+"), re.compile("[\u0483-\u1fff\u20d0-\u20ff\u2c00-\u2dff\u3000-\U0001e95a]")


def plain(text: str) -> str:
    """Compatibility form without accents and invisible characters."""
    if text.isascii():
        return text
    text = _LATIN_ACCENTS.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)))
    return _ACCENTS.sub("", text) if _OTHER_SCRIPTS.search(text) else text


def sentence_words(text: str | None, company: str | None = None) -> list[str]:
    """The sentences of a text as lower-case words joined by blanks: no digits, no hyphens, no company name; hyphenation at
    line ends undone."""
    if not text:
        return []
    name = " ".join(_WORDS.findall(plain(company).replace("-", "").lower())) if company else ""
    out = []
    flat = plain(text)
    hyphens = "-" in flat or "‐" in flat or "‑" in flat
    for paragraph in _PARAGRAPH.split(_BREAK.sub(r"\1", flat) if hyphens else flat):
        flat = _FIRMS.sub(r"\1", _UNITS.sub(r"\1", " ".join(paragraph.split())))
        for s in _ENDS.split((_HYPHEN.sub("", flat) if hyphens else flat).replace("’", "'").lower()):
            words = " ".join(_WORDS.findall(s))
            if name and name in words:
                words = " ".join(words.replace(name, " ").split())
            if words:
                out.append(words)
    return out


def document_sentences(documents: DataFrame) -> DataFrame:
    """doc_id, words, n: the sentence types of each document and how often they stand in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, words = [], []
            for d, t, c in zip(*[b.column(i).to_pylist() for i in range(3)]):
                for s in sentence_words(t, c):
                    ids.append(d)
                    words.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(words, pa.string())], ["doc_id", "words"])

    company = F.col("company") if "company" in documents.columns else F.lit(None)
    src = documents.where(F.col("text").isNotNull()).select("doc_id", "text", company.cast("string").alias("company"))
    return src.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, words STRING").groupBy("doc_id", F.xxhash64("words").alias("type")).agg(F.first("words").alias("words"), F.count("*").alias("n"))


def _phrases(words: Column) -> Column:
    """All runs of one to three words."""
    w = F.split(words, " ")
    grams = [w]
    for n in (2, 3):
        last = F.size(w) - n
        grams.append(F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i, n=n: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*grams))


def _top_two(names: list[str]) -> Column:
    """Array of (value, subject) from columns c_0 .. c_k, best first."""
    return F.sort_array(F.array(*[F.struct((F.col(f"c_{i}")).alias("v"), F.lit(s).alias("s")) for i, s in enumerate(names)]), asc=False)


def propagate(documents: DataFrame, areas: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, keep_seeds: bool = True) -> DataFrame:
    """doc_id, subject. ``keep_seeds=False`` leaves the seeds' labels out of the result, to measure the propagation."""
    names = sorted(r[0] for r in areas.select("subject").distinct().collect())  # the fixed list of areas
    seeds = seeds.select("doc_id", "subject").where(F.col("doc_id").isNotNull() & F.col("subject").isNotNull()).distinct()
    clamped = seeds.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    whole = written(document_sentences(documents), "doc-sentences")
    held = whole.select("doc_id", "type", "n")
    types = whole.groupBy("type").agg(F.first("words").alias("words"))
    edges = written(types.select("type", F.explode(_phrases(F.col("words"))).alias("phrase")).select("type", F.xxhash64("phrase").alias("phrase")), "sentence-phrases")
    # the share of the corpus that seeds make up
    both = held.join(clamped, "doc_id", "left").agg(F.sum("n"), F.sum(F.when(F.col("subjects").isNotNull(), F.col("n")))).first()
    seeded = (both[1] or 0) / (both[0] or 1)
    labels, said, found, before = clamped, None, None, 0
    for r in range(rounds):
        # 1. documents -> sentence types -> phrases
        hits = [F.sum(F.when(F.array_contains("subjects", s), F.col("n")).otherwise(F.lit(0))).alias(f"c_{i}") for i, s in enumerate(names)]
        counted = F.when(F.col("subjects").isNotNull(), F.col("n")).otherwise(0) if r == 0 else F.col("n")  # the first round counts in seeds
        evidence = held.join(labels, "doc_id", "left").groupBy("type").agg(F.sum(counted).alias("total"), F.sum("n").alias("everywhere"), *hits)
        if said is not None:  # what the rest of a sentence says counts even where its document wasn't found
            evidence = evidence.join(said, "type", "left").select("type", "total", "everywhere", *[F.when(F.col("subject") == s, F.col("total")).otherwise(F.col(f"c_{i}")).alias(f"c_{i}") for i, s in enumerate(names)])
        tally = edges.join(evidence, "type").groupBy("phrase").agg(F.sum("total").alias("total"), F.sum("everywhere").alias("everywhere"), *[F.sum(f"c_{i}").alias(f"c_{i}") for i in range(len(names))])
        best = tally.where(F.col("total") >= MIN_OCCURRENCES).select("phrase", "total", "everywhere", _top_two(names).alias("t"))
        if r == 0:
            best = best.where(F.col("t")[0]["v"] >= LIFT * seeded * F.col("everywhere"))
            among = F.array(*[F.col(f"c_{i}") for i in range(len(names))])
            by_seeds = written(tally.where(F.col("total") >= VETO).select("phrase", F.col("total").alias("s_total"), among.alias("s_c")), "seed-phrases")
        else:
            for_it = F.element_at(F.map_from_arrays(F.array(*[F.lit(x) for x in names]), F.col("s_c")), F.col("t")[0]["s"])
            best = best.join(by_seeds, "phrase", "left").where(F.col("s_total").isNull() | (for_it >= 0.5 * F.col("s_total")))
        first, second = F.col("t")[0]["v"] / F.col("total"), F.col("t")[1]["v"] / F.col("total") if len(names) > 1 else F.lit(0.0)
        verified = best.where((first >= MAJORITY) & (first - second >= MARGIN)).select("phrase", F.col("t")[0]["s"].alias("subject"), (first - second).alias("weight"))
        # 2. phrases -> sentence types
        votes = edges.join(verified, "phrase").groupBy("type").agg(*[F.sum(F.when(F.col("subject") == s, F.col("weight")).otherwise(0.0)).alias(f"c_{i}") for i, s in enumerate(names)])
        said = votes.select("type", _top_two(names).alias("t")).where(F.col("t")[0]["v"] > 2 * (F.col("t")[1]["v"] if len(names) > 1 else F.lit(0.0))).select("type", F.col("t")[0]["s"].alias("subject"))
        said = written(said, f"sentences-{r}")
        # 3. sentence types -> documents
        found = held.join(said, "type").groupBy("doc_id", "subject").agg(F.sum("n").alias("sentences")).where(F.col("sentences") >= MIN_SENTENCES).select("doc_id", "subject")
        found = written(found, f"labels-{r}")
        n = found.count()
        if r + 1 == rounds or (r and abs(n - before) <= CONVERGED * before):
            break
        before = n
        free = found.join(clamped, "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
        labels = clamped.unionByName(free)
        if r == 0:  # phrases that the seeds have with any subject can't be verified later; most of the edges lead to such
            idle = by_seeds.where(F.array_max("s_c") < 0.5 * F.col("s_total")).select("phrase")
            edges = written(edges.join(idle, "phrase", "left_anti"), "sentence-phrases")
    return found.unionByName(seeds).distinct() if keep_seeds else found
