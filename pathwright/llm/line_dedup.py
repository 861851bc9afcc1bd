"""Lines that repeat across documents: found by hash in range partitions, kept in the document of the largest id, returned as bitmaps.

One row for each line of at least MIN_CHARS code points, with two 64-bit hashes of its key, is dealt by range of hash, document and
position, largest document first. A task reads its rows in that order and sees a key's documents one after another: lines of the first
document stay, those of the third and later ones go, those of the second wait until a third comes. A key that many documents hold is
cut over several tasks like any other range; what such a cut leaves open (the first key of a task, the last one's second document) is
settled by the up to three largest documents that each side of a cut reports, two keys a task. The text itself is read again only for
the result, beside a compressed bitmap of the lines that stay."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written

MIN_CHARS = 20
MIN_DOCS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A row without an id is of the document that comes before all others.
_NO_ID = -(1 << 63)
_DROP, _OPEN, _EDGE = 0, 1, 2
_FOUND = "kind byte, h1 long, h2 long, doc long, t1 long, t2 long, pos int"
_FIELDS = ["h1", "h2", "doc", "t1", "t2", "pos"]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, t1, t2 (which row of the document, by its text) and text of every row; a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), text.alias("text"))
    return own.select("doc", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _UPPER, _LOWER)


class _Stream:
    """Reads one task's lines in order. What is held is of one key: the lines of less than MIN_DOCS documents."""

    def __init__(self) -> None:
        self.key: tuple[int, int] | None = None
        self.first = True  # the key may have begun in an earlier task
        self.doc = self.rank = 0  # the document read last, and its place among those of the key
        self.top: list[int] = []  # the key's largest documents, MIN_DOCS at most
        self.held: list[list[np.ndarray]] = []  # lines that go once there are enough documents

    @staticmethod
    def _out(kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int8)), *map(pa.array, columns)], names=["kind", *_FIELDS])

    def _feed(self, c: list[np.ndarray], rank: np.ndarray) -> Iterator[pa.RecordBatch]:
        """More lines of the present key."""
        if len(self.top) < MIN_DOCS:
            self.top = sorted({*self.top, *c[2][rank <= MIN_DOCS].tolist()}, reverse=True)[:MIN_DOCS]
        enough = rank[-1] >= MIN_DOCS
        if self.first and (rank == 1).any():  # the largest document may lie in an earlier task
            yield self._out(_OPEN, [x[rank == 1] for x in c])
        if (later := rank > 1).any():
            self.held.append([x[later] for x in c])
        if enough:
            yield from (self._out(_DROP, h) for h in self.held)
            self.held = []

    def close(self, at_end: bool) -> Iterator[pa.RecordBatch]:
        """The present key is over, in this task at least."""
        if self.key is not None and (self.first or at_end):
            n, zero = len(self.top), np.zeros(len(self.top), np.int64)
            yield self._out(_EDGE, [np.full(n, self.key[0]), np.full(n, self.key[1]), np.array(self.top, np.int64), zero, zero, zero.astype(np.int32)])
            yield from (self._out(_OPEN, h) for h in self.held)
        self.held, self.top = [], []

    def read(self, c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h1, h2, doc = c[:3]
        n = len(h1)
        new, other = np.empty(n, bool), np.empty(n, bool)
        new[0], other[0] = self.key != (h1[0], h2[0]), doc[0] != self.doc
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        other[1:] = doc[1:] != doc[:-1]
        starts, step = np.flatnonzero(new), np.cumsum(other | new)
        rank = step - np.concatenate([[-self.rank], step[starts] - 1])[np.cumsum(new)]
        cuts = [0, *([starts[0], *starts[[1, -1]]] if len(starts) > 2 else starts), n]
        # what goes on, the first key of all, keys that begin and end here, the last key
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part, r = [x[lo:hi] for x in c], rank[lo:hi]
            if lo == hi:
                continue
            if len(starts) > 2 and lo == starts[1]:
                yield from self.close(False)
                self.first, self.key = False, None
                run = np.cumsum(new[lo:hi]) - 1
                size = r[np.append(np.flatnonzero(new[lo:hi])[1:], hi - lo) - 1]
                if (gone := (size[run] >= MIN_DOCS) & (r > 1)).any():
                    yield self._out(_DROP, [x[gone] for x in part])
                self.key = (part[0][-1], part[1][-1])
                continue
            if new[lo]:
                yield from self.close(False)
                self.first = self.key is None
                self.key = (h1[lo], h2[lo])
            yield from self._feed(part, r)
        self.doc, self.rank = doc[-1], int(rank[-1])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stream = _Stream()
    for batch in batches:
        if batch.num_rows:
            yield from stream.read([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(_FIELDS))])
    yield from stream.close(True)


def _dropped(rows: DataFrame) -> DataFrame:
    """doc, t1, t2, pos of the lines that go."""
    lines = rows.select("doc", "t1", "t2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= MIN_CHARS)
    lines = lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "t1", "t2", "pos")
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("pos")]
    found = written(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream, _FOUND), "line-runs")
    edges = found.where(f"kind = {_EDGE}").groupBy("h1", "h2").agg(F.max("doc").alias("largest"), F.count_distinct("doc").alias("docs")).where(f"docs >= {MIN_DOCS}")
    settled = found.where(f"kind = {_OPEN}").join(F.broadcast(edges), ["h1", "h2"]).where("doc < largest")  # two keys a task of the range exchange
    return found.where(f"kind = {_DROP}").select("doc", "t1", "t2", "pos").union(settled.select("doc", "t1", "t2", "pos"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in slices(batches):
        maps, counts = [], []
        places = batch.column(3)
        for k in range(batch.num_rows):
            gone = np.unique(places[k].values.to_numpy())
            keep = np.ones((int(gone[-1]) | 7) + 1, bool)  # whole bytes
            keep[gone] = False
            maps.append(squeeze.compress(np.packbits(keep).tobytes()))
            counts.append(len(gone))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], names=["doc", "t1", "t2", "n_dropped", "keep"])


def _keep(rows: DataFrame) -> DataFrame:
    gone = _dropped(rows).groupBy("doc", "t1", "t2").agg(F.collect_list("pos").alias("gone"))  # a document's own lines
    return gone.mapInArrow(_bitmaps, "doc long, t1 long, t2 long, n_dropped long, keep binary")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t1, t2 (hashes of the text, for rows that share an id), n_dropped and keep of every document that loses lines.

    keep: zstd of packed bits, 1 for a line that stays, up to the last line that goes; lines after it stay. A line goes if its key (white
    space of ASCII stripped at both ends, A-Z lower-cased) has at least 20 code points and is found in at least 3 documents, of which this
    one is not the one with the largest doc_id. Rows with one id are one document; rows without an id are one document, before all others.
    A null text is one empty line. Repeated rows lose the same lines; an empty table gives none. Keys are told apart by 128 bits of hash."""
    found = _keep(_rows(docs, id_col, text_col))
    return found.select(F.nullif("doc", F.lit(_NO_ID)).alias(id_col), "t1", "t2", "n_dropped", "keep")


def stays(keep: bytes | None, n: int) -> np.ndarray:
    """Which of n lines stay."""
    bits = np.ones(n, bool)
    if keep is not None:
        some = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(keep), np.uint8)).astype(bool)[:n]
        bits[: len(some)] = some
    return bits


def kept_lines(text: str | None, keep: bytes | None) -> tuple[int, str]:
    """How many lines the text has, and those that stay."""
    if keep is None:
        return (text or "").count("\n") + 1, text or ""
    lines = (text or "").split("\n")
    return len(lines), "\n".join(line for line, b in zip(lines, stays(keep, len(lines)), strict=True) if b)


def _joined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = _rows(docs, id_col, text_col)
    return rows.join(_keep(rows), ["doc", "t1", "t2"], "left").select("doc", "text", "n_dropped", "keep")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        lines, digests = [], []
        for text, keep in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            n, kept = kept_lines(text, keep)
            lines.append(n)
            digests.append(hashlib.sha256(kept.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), batch.column(2), pa.array(digests, pa.string())], names=["doc", "n_lines", "n_dropped", "kept_sha256"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row, from its text and its bitmap (see keep_bitmaps)."""
    fields = T.StructType([T.StructField("doc", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    got = _joined(docs, id_col, text_col).mapInArrow(_digested, fields)
    return got.select(F.nullif("doc", F.lit(_NO_ID)).alias(id_col), "n_lines", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "kept_sha256")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        kept = [kept_lines(t, k)[1] for t, k in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=["doc", "text"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text of every row, without the lines that go."""
    got = _joined(docs, id_col, text_col).mapInArrow(_texts, "doc long, text string")
    return got.select(F.nullif("doc", F.lit(_NO_ID)).alias(id_col), F.col("text").alias(text_col))
