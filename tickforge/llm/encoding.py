"""Encoding texts with a public byte-level BPE vocabulary, by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last one of the prefix's encoding. ``PrefixTable`` stores
it: the candidate token that ends there and that is compatible with the last token of the shorter prefix before it.
Two tokens are compatible if encoding their joined bytes gives the two again, which the merge ranks decide without
encoding anything. Appending bytes only adds entries, so an append is exact and costs its own length; the tokens of any
prefix are read off backwards. ``EncodedText`` does the same for whole texts, whose splitting pattern looks at most two
characters ahead, so an edit re-encodes only the pieces near it.

Defined cases: null and empty texts give an empty list; strings that look like special tokens are ordinary text; very
long texts and very long pieces are linear in their length; repeated texts and ids give repeated rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that cuts a text into pieces before the merges.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Encoded pieces that a worker remembers. More pieces cost time, not results.
_REMEMBERED = 400_000


class Vocabulary:
    """Tokens, the pair that each was merged from, and the test whether two tokens may stand side by side."""

    def __init__(self, path: str = VOCABULARY):
        ranks = {}
        for line in Path(path).read_bytes().splitlines():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
        self.ids = ranks
        self.size = max(ranks.values()) + 1
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.usable: dict[bytes, int] = {}
        for token, i in ranks.items():
            if len(token) == 1:
                self.usable[token] = i
                continue
            pair = self._merged_from(token)
            if pair:  # else the merges never produce this token from its own bytes
                self.parts[i] = pair
                self.joined[pair] = i
                self.usable[token] = i

    def _merged_from(self, token: bytes) -> tuple[int, int] | None:
        """The last two parts when the merges run over the token's own bytes; None if they don't end in it."""
        ids = self.ids
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = ids.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (ids[parts[0]], ids[parts[1]]) if parts[0] in ids and parts[1] in ids else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` apart when their bytes stand side by side.

        Go back through the merges on both sides of the boundary, latest first. A merge across the boundary would have
        been taken if its rank is below that of the merge just undone, as it was then already possible."""
        below = self.size + 1
        joined, parts = self.joined, self.parts
        while True:
            across = joined.get((left, right))
            if across is not None and across < below:
                return False
            if left > right:
                below = left
                if left in parts:
                    left = parts[left][1]
                    continue
                # the left side is a single byte by now; only the right one is left to undo
                if right not in parts:
                    return True
                below = right + 1
                right = parts[right][0]
            else:
                below = right + 1
                if right in parts:
                    right = parts[right][0]
                    continue
                if left not in parts:
                    return True
                below = left
                left = parts[left][1]


class PrefixTable:
    """The last token of every prefix of a growing byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        v, last = self.vocabulary, self.last
        start = len(self.data)
        data = self.data = self.data + more
        usable, compatible, longest = v.usable, v.compatible, v.longest
        for end in range(start + 1, len(data) + 1):
            for begin in range(end - 1, max(-1, end - longest - 1), -1):
                token = usable.get(data[begin:end])
                if token is not None and (begin == 0 or compatible(last[begin - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary has no token for a byte")
        return self

    def truncate(self, length: int) -> PrefixTable:
        del self.last[length:]
        self.data = self.data[:length]
        return self

    def tokens(self, length: int | None = None, sizes: dict[int, int] | None = None) -> list[int]:
        """The encoding of the prefix of ``length`` bytes (default: all)."""
        end = len(self.data) if length is None else length
        out = []
        sizes = sizes or token_sizes(self.vocabulary)
        while end:
            t = self.last[end - 1]
            out.append(t)
            end -= sizes[t]
        return out[::-1]


def token_sizes(v: Vocabulary) -> dict[int, int]:
    if not hasattr(v, "_sizes"):
        v._sizes = {i: len(t) for t, i in v.ids.items()}
    return v._sizes


class Encoder:
    """Texts to ids; remembers the encodings of pieces."""

    def __init__(self, path: str = VOCABULARY):
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        got = self.known.get(piece)
        if got is None:
            got = PrefixTable(self.vocabulary, piece.encode("utf-8", "replace")).tokens()
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            known, piece = self.known, self.piece
            for p in PIECES.findall(text):
                out += known.get(p) or piece(p)
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, piece = self.known, self.piece
        return sum(len(known.get(p) or piece(p)) for p in PIECES.findall(text))


class EncodedText:
    """A text with its pieces and ids, for appends and edits that re-encode only what they change."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.pieces = [(m.start(), m.end(), encoder.piece(m.group())) for m in PIECES.finditer(text)]

    @property
    def ids(self) -> list[int]:
        return [t for _, _, ts in self.pieces for t in ts]

    def append(self, more: str) -> EncodedText:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> EncodedText:
        """Replace ``text[start:end]``. Pieces that end more than two characters before ``start`` stay, as the pattern looks
        no further ahead; from there pieces are cut again until a boundary behind the edit falls on an old one."""
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        first = next((i for i, p in enumerate(self.pieces) if p[1] >= start - 2), len(self.pieces))
        at = self.pieces[first][0] if first < len(self.pieces) else start
        old = {p[0] + shift: i for i, p in enumerate(self.pieces) if p[0] >= end}
        fresh, tail = [], []
        for m in PIECES.finditer(text, at):
            if m.start() >= start + len(new) and m.start() in old:
                tail = [(a + shift, z + shift, ts) for a, z, ts in self.pieces[old[m.start()] :]]
                break
            fresh.append((m.start(), m.end(), self.encoder.piece(m.group())))
        self.pieces, self.text = self.pieces[:first] + fresh + tail, text
        return self


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """id, ids: the token ids of every row's text."""
    src = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in batches:
            ids = pa.array([encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [id_col, "ids"])

    return src.mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, ids ARRAY<INT>")


def count_tokens(df: DataFrame, text_col: str = "text", out: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """All columns of ``df`` and the number of tokens of its text."""
    from pyspark.sql import types as T

    keep = [f for f in df.schema if f.name != out]
    src = df.select(*[F.col(f"`{f.name}`") for f in keep])
    names = [f.name for f in keep]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path).count
        for b in batches:
            n = pa.array([count(t) for t in b.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n], [*names, out])

    return src.mapInArrow(run, T.StructType([*keep, T.StructField(out, T.LongType())]))
