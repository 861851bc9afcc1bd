"""Benchmark decontamination by Wu-Manber search for windows of benchmark words.

The alphabet is the word, as a number. For each window length m a shift table says how far the end of a window can move on
after a block of words was seen, so that most positions are never looked at; where the shift is 0, the bucket of the block
(the suffix) gives the windows that are then compared, first by the hash of their first words (the prefix), then word by word.
All tables are flat arrays over the benchmark's words, with shift and bucket by a hash of the block: a shift that several blocks
share is the least of theirs.

A benchmark is taken in passes of about PASS_WORDS words each, so that driver and workers hold a bounded part of it: items are cut
into pieces of PIECE_WORDS words that overlap by a window less one word, and pieces are dealt to passes by a hash. With one
pass, the scan gives the result. With more, the documents are written once with a row number; each pass reads that table and
writes only the rows it hits; the passes' hits, grouped by row, are joined to the table. An item's windows lie all in its pieces.

Defined results: null and wordless texts have no words and no hits; a null or wordless item has no window; equal items
and repeated rows of an item count once; a null item_id still marks words, but is not listed. Every row of docs gives
one row, repeated rows too. Extra columns are kept by scan_windows() and dropped by decontaminate()."""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_scan, fresh, slices, written

WINDOW = 10
BLOCK = 3
#: Benchmark words of one pass, and of one piece of an item.
PASS_WORDS = 1_000_000
PIECE_WORDS = 4096

_KEPT = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_FOLD = bytes(b if b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


_A, _B = 0x9E3779B1, 0x85EBCA77


class Group:
    """The tables of the windows of one length: starts are places in the flat text, in the order of their suffixes' buckets."""

    def __init__(self, m: int, flat: np.ndarray, starts: np.ndarray):
        self.m, self.block = m, min(BLOCK, m)
        bits = max(8, int(4 * len(starts)).bit_length())
        self.mask = (1 << bits) - 1
        self.shift = np.full(1 << bits, m - self.block + 1, np.uint8)
        for end in range(self.block, m + 1):
            np.minimum.at(self.shift, self.hashed(flat, starts + end - self.block), m - end)
        bucket = self.hashed(flat, starts + m - self.block)
        order = np.argsort(bucket, kind="stable")
        whole = lambda x: array("I", x.astype(np.uint32).tobytes())
        self.first = whole(np.searchsorted(bucket[order], np.arange((1 << bits) + 1)))
        self.starts, self.prefix = whole(starts[order]), whole(self.hashed(flat, starts[order]))

    def hashed(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The hashes of the blocks that begin at some places."""
        h = np.zeros(len(at), np.uint64)
        for k in range(self.block):
            h = h * np.uint64(_A) + text[at + k].astype(np.uint64) * np.uint64(_B)
        return ((h ^ (h >> np.uint64(29))) & np.uint64(self.mask)).astype(np.int64)


class WuManber:
    """Finds every occurrence of the windows of items (item, words): each in its owners' lists."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], size: int = WINDOW):
        self.number: dict[bytes, int] = {}
        flat, begins, self.owner = array("i"), array("I"), []
        for item, words in items:
            if words:
                begins.append(len(flat))
                self.owner.append(item)
                flat.extend(self.number.setdefault(w, len(self.number)) for w in words)
        self.flat, self.begins = flat, begins
        text, begin = np.frombuffer(flat, np.int32), np.append(np.frombuffer(begins, np.uint32).astype(np.int64), len(flat))
        length = np.diff(begin)
        self.groups, self.shared = [], {}
        for m in np.unique(np.minimum(length, size)).tolist():
            one = np.flatnonzero(np.minimum(length, size) == m)
            count = length[one] - m + 1
            starts = np.repeat(begin[one] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            self.groups.append(Group(m, text, self._distinct(text, starts, np.repeat(one, count), m)))

    def _distinct(self, text: np.ndarray, starts: np.ndarray, source: np.ndarray, m: int) -> np.ndarray:
        """One place of each window; `shared` keeps, by length and place, the items of a window that several have."""
        order = np.lexsort([text[starts + k] for k in range(m)])
        s, who = starts[order], source[order]
        new = np.ones(len(s), bool)
        new[1:] = False
        for k in range(m):
            new[1:] |= text[s[1:] + k] != text[s[:-1] + k]
        at = np.flatnonzero(new)
        size = np.diff(at, append=len(s))
        for i in np.flatnonzero(size > 1):
            self.shared[m, int(s[at[i]])] = np.unique(who[at[i] : at[i] + size[i]]).tolist()
        return s[at]

    def numbers(self, words: Iterable[bytes]) -> Iterator[int]:
        """The numbers of words; -1 for a word that no window holds."""
        return map(self.number.get, words, repeat(-1))

    def search(self, text: list[int]) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, end, numbers of the items) of each occurrence in a text of numbers; no window reaches over a -1."""
        n, at = len(text), np.array(text, np.int64)
        unknown = at < 0
        for g in self.groups:
            m, b = g.m, g.block
            if n < m:
                continue
            h = np.zeros(n + 1, np.int64)  # of the block that ends there
            h[b:] = g.hashed(at, np.arange(n - b + 1))
            move = g.shift[h]
            for k in range(b, 0, -1):  # past an unknown word in the block
                move[k:][unknown[: n + 1 - k]] = m - k + 1
            jump, end = move.tobytes(), m
            if jump.find(b"\0", m) < 0:
                continue
            while end <= n:
                if jump[end]:
                    end += jump[end]
                    continue
                start, key = end - m, int(h[end])
                if g.first[key] < g.first[key + 1]:
                    head, own = int(h[start + b]), array("i", text[start:end])
                    for k in range(g.first[key], g.first[key + 1]):
                        place = g.starts[k]
                        if g.prefix[k] == head and self.flat[place : place + m] == own:
                            yield start, end, self.shared.get((m, place)) or [bisect_right(self.begins, place) - 1]
                end += 1


def windows(items: Iterable[tuple], size: int = WINDOW) -> dict[tuple, set]:
    """The windows of items (item, text) with their owners; for comparison."""
    found: dict[tuple, set] = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            found.setdefault(tuple(w[i : i + size]), set()).add(item)
    return found


def _scanner(tables):
    """The function from texts to n_words, spans (starts and ends, disjoint and in order for one length) and items, per text."""

    def factory():
        wm = tables.value

        def scan(texts: list) -> list[pa.Array]:
            n_words, text = [], []
            for t in texts:
                w = words_of(t)
                n_words.append(len(w))
                text.extend(wm.numbers(w))
                text.append(-1)  # between texts
            ends = np.cumsum(np.array(n_words, np.int64) + 1).tolist()
            spans: list[list[int]] = [[] for _ in texts]
            owned: list[set] = [set() for _ in texts]
            for start, end, owners in wm.search(text):
                k = bisect_right(ends, start)
                base, at = ends[k] - n_words[k] - 1, spans[k]
                if at and at[-2] <= start - base <= at[-1]:
                    at[-1] = max(at[-1], end - base)
                else:
                    at += (start - base, end - base)
                owned[k].update(owners)
            items = [sorted({x for i in ids if (x := wm.owner[i]) is not None}) for ids in owned]
            return [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]

        return scan

    return factory


def _pieces(benchmark: DataFrame, size: int) -> DataFrame:
    """(item, words, n): distinct pieces of the items' words, space-joined."""

    def cut(batches):
        for batch in slices(batches):
            out: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words_of(text)
                for at in range(0, max(1, len(w) - size + 1) if w else 0, PIECE_WORDS):
                    part = w[at : at + PIECE_WORDS + size - 1]
                    out.append((item, b" ".join(part), len(part)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int64())], names=["item", "words", "n"])

    return benchmark.mapInArrow(cut, "item string, words binary, n long").distinct()


_KINDS = (T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType()))


def scan_windows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns appended, and their names by n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    pieces = written(_pieces(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")), size), "pieces")
    passes = (pieces.agg(F.sum("n")).first()[0] or 0) // PASS_WORDS + 1
    names = {x: fresh(docs, f"pw_{x}") for x in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
    marks = [fresh(docs, f"pw_{x}") for x in ("words", "spans", "items")]
    fields = [T.StructField(n, t) for n, t in zip(marks, _KINDS, strict=True)]

    def scanned(df: DataFrame, k: int) -> DataFrame:
        part = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(passes)) == k)
        return append_scan(df, text_col, fields, _scanner(spark.sparkContext.broadcast(WuManber(((r["item"], bytes(r["words"]).split()) for r in part.select("item", "words").toLocalIterator()), size))))

    if passes == 1:
        df = scanned(docs, 0)
    else:
        row = fresh(docs, "pw_row")
        whole = written(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminated")
        hits = None
        for k in range(passes):
            found = scanned(whole.select(row, text_col), k).select(row, *marks)
            found = written(found.where(F.size(marks[1]) > 0).select(row, *marks[1:]), "hits")
            hits = found if hits is None else hits.unionByName(found)
        hits = hits.groupBy(row).agg(*[F.flatten(F.collect_list(m)).alias(m) for m in marks[1:]])  # one row a pass at most
        counted = append_scan(whole, text_col, fields[:1], lambda: lambda texts: [pa.array([len(words_of(t)) for t in texts], pa.int64())])
        df = counted.join(hits, row, "left").withColumns({m: F.coalesce(m, F.array().cast(f.dataType)) for m, f in zip(marks[1:], fields[1:], strict=True)})
    df = append_scan(df, marks[1], [T.StructField(names["n_hit"], T.LongType())], lambda: _covered)
    listed = fresh(docs, "pw_listed")
    df = df.withColumn(listed, F.array_sort(F.array_distinct(marks[2])))
    df = df.withColumns({names["n_words"]: F.col(marks[0]), names["n_items"]: F.size(listed).cast("long"), names["items_sha256"]: F.sha2(F.array_join(listed, ","), 256), names["contaminated"]: F.col(names["n_hit"]) > 0})
    return df.select(*docs.columns, *names.values()), names


def _covered(rows: list) -> list[pa.Array]:
    """Words that lie in any of the spans."""
    out = []
    for flat in rows:
        reach = n = 0
        for start, end in sorted(zip(flat[::2], flat[1::2], strict=True)):
            n += max(0, end - max(start, reach))
            reach = max(reach, end)
        out.append(n)
    return [pa.array(out, pa.int64())]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs."""
    df, names = scan_windows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark)
    return df.select("doc_id", *[F.col(v).alias(k) for k, v in names.items()])


def clean_only(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark window, with their columns as they were."""
    df, names = scan_windows(docs, benchmark)
    return df.where(~F.col(names["contaminated"])).select(*docs.columns)
