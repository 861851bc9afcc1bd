"""How far the sources of a language differ in their terms, from joint histograms of counts.

Tasks count terms by language and source; one row a language, source and term is left. For each pair of sources of a language the terms
are tallied by their two counts, in the task that holds the term, so that no pair of a term's sources leaves it as a row; a cell where one
count is zero follows from the source's own histogram less the cells of the pair, and the cell of two zeros from the number of terms. The
divergence f is then worked out once for each cell and multiplied by the cell's terms. All arithmetic is on whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Numbering, slices, written

MIN_DOCS = 10
TOP = 10
#: Entries that a task counts before it sends them on, and entries whose pairs it tallies at once.
HELD = 1_200_000
TALLIED = 500_000
SCALE = 1_000_000_000
#: Bytes of UTF-8 that are in no term become spaces; A-Z become lower case. A term is a run of a-z and of characters beyond ASCII.
_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_COUNTED = "lang string, source string, term string, n long, df long"
_TALLY = "lang string, a string, b string, ca long, cb long, m long"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source; a null term for each group that occurs. Groups and terms have numbers while the task holds them."""
    groups, words = Numbering(), Numbering()
    held: list[np.ndarray] = []  # parts of three rows: group and term in one number, occurrences, documents

    def added(key: np.ndarray, n: np.ndarray, df: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
        return np.vstack([key[first], np.add.reduceat(n[order], first), np.add.reduceat(df[order], first)]) if len(key) else np.zeros((3, 0), np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        key, n, df = added(*np.concatenate(held, axis=1)) if held else np.zeros((3, 0), np.int64)
        lang, source = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
        term = pa.array([w.decode() for w in words], pa.string())
        none = np.zeros(len(groups), np.int64)
        yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(groups), pa.string()), pa.array(none), pa.array(none)], names=["lang", "source", "term", "n", "df"])
        for at in range(0, len(key), 1 << 16):
            part = slice(at, at + (1 << 16))
            group, word = pa.array(key[part] >> 32), pa.array(key[part] & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([lang.take(group), source.take(group), term.take(word), pa.array(n[part]), pa.array(df[part])], names=["lang", "source", "term", "n", "df"])
        held.clear()
        groups.clear()
        words.clear()

    size = 0
    for batch in slices(batches):
        own: list[bytes] = []
        ends, group = [], []
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own += terms(text)
            ends.append(len(own))
            group.append(groups[lang, source])
        word = np.fromiter(map(words.__getitem__, own), np.int64, len(own))
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        one, n = np.unique(doc << 32 | word, return_counts=True)  # a document's terms
        held.append(added(np.array(group, np.int64)[one >> 32] << 32 | (one & 0xFFFFFFFF), n, np.ones_like(n)))
        size += held[-1].shape[1]
        many = len(words) > HELD // 2 or len(groups) > HELD // 2
        if size > 2 * HELD or many:
            held[:] = [added(*np.concatenate(held, axis=1))]
            size = held[0].shape[1]
            if size > HELD or many:
                yield from out()
                size = 0
    if groups:
        yield from out()


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each pair of sources by their two counts, both above zero. A row of the input is a term with its sources in order."""
    langs: dict[str, int] = {}
    sources: dict[str, int] = {}
    kept: list[np.ndarray] = []  # parts of five columns: language, source, source, count, count

    def number(names: list[str], of: dict[str, int]) -> np.ndarray:
        return np.fromiter((of.setdefault(x, len(of)) for x in names), np.int64, len(names))

    def added(parts: list[np.ndarray]) -> np.ndarray:
        """Distinct columns and, as the last row, how often they are there."""
        all_ = np.concatenate(parts, axis=1)
        all_ = all_[:, np.lexsort(all_[:5])]
        first = np.flatnonzero(np.concatenate([[True], (all_[:5, 1:] != all_[:5, :-1]).any(axis=0)]))
        return np.vstack([all_[:5, first], np.add.reduceat(all_[5], first)])

    def out() -> Iterator[pa.RecordBatch]:
        if kept:
            cells = added(kept)
            name = lambda of, k: pa.array(list(of), pa.string()).take(pa.array(k))
            yield pa.RecordBatch.from_arrays([name(langs, cells[0]), name(sources, cells[1]), name(sources, cells[2]), *(pa.array(x) for x in cells[3:])], names=["lang", "a", "b", "ca", "cb", "m"])
            kept.clear()

    size = 0
    for batch in slices(batches, 8192):
        lists = batch.column(1)
        entries = lists.flatten()
        sizes = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), sizes)
        lang = number(batch.column(0).to_pylist(), langs)[row]
        source, n = number(entries.field(0).to_pylist(), sources), entries.field(1).to_numpy(zero_copy_only=False)
        for k in range(1, int(sizes.max(initial=1))):
            i = np.flatnonzero(row[k:] == row[:-k])
            for at in range(0, len(i), TALLIED):
                j = i[at : at + TALLIED]
                kept.append(added([np.vstack([lang[j], source[j], source[j + k], n[j], n[j + k], np.ones(len(j), np.int64)])]))
                size += kept[-1].shape[1]
            if size > TALLIED and len(kept) > 1:
                kept[:] = [added(kept)]
                size = kept[0].shape[1]
                if size > TALLIED:
                    yield from out()
                    size = 0
        if len(langs) + len(sources) > HELD:
            yield from out()
            size = 0
            langs.clear()
            sources.clear()
    yield from out()


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n, df: occurrences of each term and documents that hold it; a row with a null term for each (lang, source)."""
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    return own.mapInArrow(_count, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(count: Column, total: Column, terms_: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), beyond 64 bits where need be."""
    wide = F.lit(SCALE).cast("decimal(38,0)") * (count + 2).cast("decimal(20,0)")
    return 1 + F.call_function("div", wide, F.nullif(total + 2 * terms_, F.lit(0)).cast("decimal(20,0)"))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has each other source of the language with the sum of f over the language's
    terms, part `term` the terms that the source uses more than its language does, the `top` of largest f.

    Null text, lang and source are empty text. A term is kept for a language if at least min_docs of its rows hold it. A source with
    empty texts only, or a language without kept terms, has its pairs (of value 0 if no term is kept); a language of one source has no
    pair. Repeated rows count as often as they are there. An empty table gives no row. Ties of value go by the UTF-8 bytes of the item."""
    entries = written(counted(docs, text_col, lang_col, source_col), "term-counts")
    listed = F.array_sort(F.collect_list(F.struct("source", "n")))  # a term's sources in one language
    kept = written(entries.where("term IS NOT NULL").groupBy("lang", "term").agg(listed.alias("entries"), F.sum("n").alias("total"), F.sum("df").alias("df")).where(F.col("df") >= min_docs).drop("df"), "kept-terms")
    single = written(kept.select("lang", "term", "total", F.inline("entries")), "kept-entries")
    langs = entries.groupBy("lang").agg(F.lit(0)).select("lang").join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all")), "lang", "left").select("lang", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("v", "all")])
    groups = entries.where("term IS NULL").select("lang", "source").join(single.groupBy("lang", "source").agg(F.sum("n").alias("size")), ["lang", "source"], "left").select("lang", "source", F.coalesce("size", F.lit(0)).alias("size")).join(langs, "lang")
    groups = written(groups, "term-groups")

    a, b = groups.select("lang", F.col("source").alias("a"), F.col("size").alias("na"), "v"), groups.select("lang", F.col("source").alias("b"), F.col("size").alias("nb"))
    pairs = a.join(b, "lang").where("a < b")  # half of the result's own rows
    tally = kept.where(F.size("entries") > 1).select("lang", "entries").mapInArrow(_tally, _TALLY).groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))
    tally = written(tally, "joint-cells")
    own = single.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    zero, cell = F.lit(0).cast("long"), lambda x, y, m: F.struct(x.alias("ca"), y.alias("cb"), m.alias("m"))
    c, d, m = F.col("ca"), F.col("cb"), F.col("m")
    both = tally.select("lang", "a", "b", F.inline(F.array(cell(c, d, m), cell(c, zero, -m), cell(zero, d, -m), cell(zero, zero, m))))
    of_a = pairs.join(own.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", F.inline(F.array(cell(F.col("n"), zero, m), cell(zero, zero, -m))))
    of_b = pairs.join(own.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", F.inline(F.array(cell(zero, F.col("n"), m), cell(zero, zero, -m))))
    none = pairs.select("lang", "a", "b", zero.alias("ca"), zero.alias("cb"), F.col("v").alias("m"))
    cells = both.unionByName(of_a).unionByName(of_b).unionByName(none).groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).where("m > 0")
    f = _distance(_share(F.col("ca"), F.col("na"), F.col("v")), _share(F.col("cb"), F.col("nb"), F.col("v")))
    values = cells.join(pairs, ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum(f * F.col("m")).alias("value"))
    values = pairs.select("lang", "a", "b").join(values, ["lang", "a", "b"], "left").select("lang", "a", "b", F.coalesce("value", zero).alias("value"))
    way = lambda x, y: F.struct(F.col(x).alias("source"), F.col(y).alias("item"))
    of_pairs = values.select("lang", F.inline(F.array(way("a", "b"), way("b", "a"))), "value").select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    p, q = _share(F.col("n"), F.col("size"), F.col("v")), _share(F.col("total"), F.col("all"), F.col("v"))
    of_terms = single.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "part", "item", _distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(of_pairs).unionByName(ranked(of_terms).where(F.col("rank") <= top))
