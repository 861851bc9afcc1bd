"""Token counts of a byte-level BPE vocabulary by heap-and-linked-list merging; no identifiers are made.

A piece of text (as the vocabulary's pattern cuts it) starts as one symbol a byte in a doubly linked list. A heap holds
the ranks of adjacent pairs; the lowest rank, and of equal ranks the leftmost, is merged, and the pairs that this makes
are pushed. The count is the number of bytes less the number of merges. Counts of pieces seen before come from a table
of bounded size.

Defined results: a null text counts as the empty one (0 bytes, 0 tokens); special strings in a text are one token each,
as the vocabulary's library takes them by default. Texts are counted whole, however long; a piece of n bytes takes n log n steps. Every
row gives one row, repeated rows too; extra columns do not matter."""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_scan

#: Pieces whose counts a worker keeps, and the most characters that one of them has; beyond the first the table starts anew.
KNOWN_PIECES = 500_000
KNOWN_CHARS = 48
#: Fixed value: how byte-level vocabularies of this family cut text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in such vocabularies: printable Latin-1 as it is, the rest from 256 up."""
    out, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class PieceCounts(dict):
    """Number of tokens by piece, counted when first asked for."""

    def __init__(self, merges: list):
        self.letters = byte_letters()
        self.ids = {x: i for i, x in enumerate(self.letters)}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            whole = self.ids.setdefault(a + b, len(self.ids))
            self.rank.setdefault((self.ids[a], self.ids[b]), (r, whole))

    def __missing__(self, piece: str) -> int:
        n = self.count(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= KNOWN_CHARS:
            if len(self) >= KNOWN_PIECES:
                self.clear()
            self[piece] = n
        return n

    def count(self, data: bytes) -> int:
        rank = self.rank
        ids = self.ids
        letters = self.letters
        symbol = [ids[letters[b]] for b in data]
        n = len(symbol)
        heap = []
        for i in range(n - 1):
            found = rank.get((symbol[i], symbol[i + 1]))
            if found is not None:
                heap.append((found[0], i, found[1]))
        if not heap:
            return n
        heapq.heapify(heap)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        merges = 0
        while heap:
            r, i, whole = heapq.heappop(heap)
            a = symbol[i]
            if a < 0:
                continue
            j = right[i]
            if j >= n or rank.get((a, symbol[j])) != (r, whole):
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = whole, -1
            merges += 1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                found = rank.get((whole, symbol[k]))
                if found is not None:
                    heapq.heappush(heap, (found[0], i, found[1]))
            k = left[i]
            if k >= 0:
                found = rank.get((symbol[k], whole))
                if found is not None:
                    heapq.heappush(heap, (found[0], k, found[1]))
        return n - merges


class Vocabulary:
    """A vocabulary file of the .json kind: counts the tokens of whole texts."""

    def __init__(self, raw: bytes):
        v = json.loads(raw)
        if v["model"]["type"] != "BPE" or (v.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("not a byte-level BPE vocabulary")
        self.prefix = bool(v["pre_tokenizer"].get("add_prefix_space"))
        self.pieces = PieceCounts(v["model"]["merges"])
        self.cut = regex.compile(PIECES).findall
        special = [x["content"] for x in v.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        if self.prefix and text and not text[0].isspace():
            text = " " + text
        return sum(map(self.pieces.__getitem__, self.cut(text)))


_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(raw: bytes) -> Vocabulary:
    """One for each worker process, kept between its tasks."""
    key = hash(raw)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(raw)
    return _LOADED[key]


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. The vocabulary file (a few MB) is read by the driver and broadcast."""
    with open(vocabulary_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def factory():
        vocabulary = _vocabulary(shared.value)
        return lambda texts: [pa.array([vocabulary.count(t) for t in texts], pa.int64())]

    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    df = append_scan(df, "text", [T.StructField("n_tokens", T.LongType())], factory)
    return df.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
