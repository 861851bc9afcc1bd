"""Phrases whose words keep together, counted in arrays by slots of minimal perfect hashes.

Level by level, as every part of a frequent phrase is frequent: words are counted, and the frequent ones of a language numbered by the
slots of a minimal perfect hash. The texts are written once more as word numbers, with 0 where a piece ends or a word is rare. The
candidates of two words are the pairs of frequent words that are seen often enough, for which tasks send each pair with no more
occurrences than prove that; they get a hash of their own, and each task adds up its occurrences by slot in numpy arrays, which are summed
as a tree. Three words are a candidate's slot and one more word, where both pairs are candidates; they are counted in the same way. The
counts of a phrase's parts are read by slot.

A hash is cut into parts of at most about PART keys; a part is built by one task as levels of bits: keys that fall on a bit alone stay there, the
others go to the next level, and a key's slot is the number of bits before its own. Its keys are stored in slot order beside it, so that
a key that is not of the set is known for that; counts lie beside the keys. Parts are files in the shared folder, which workers map."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Numbering, shared_folder, slices, written
from .ngram_model import Store, mix, pack, unpack

LEAST = 10
FIRST = 2000
#: Keys of a hash's part, and parts at least; keys that a task holds before it sends them on; slots of count arrays that a task holds.
PART = 1 << 20
PARTS = 16
HELD = 1 << 22
SLOTS = 1 << 23
#: Tasks whose arrays are summed at the tree's first level.
FAN = 32
_U = np.uint64
#: Bytes of UTF-8: ends of pieces become a byte that no UTF-8 has, a tab a space, A-Z lower case.
_END = b"\xff"
_WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))


def pieces(text: str | None) -> list[bytes]:
    """Words in order, with _END between pieces."""
    return (text or "").encode().translate(_WORD).replace(_END, b" \xff ").split()


# ---- minimal perfect hashes


class Hash:
    """Which part and slot a key has. Keys are distinct 64-bit numbers; `check` holds a second number of each key where the first is itself a hash."""

    def __init__(self, uri: str, sizes: list[int], words: list[list[int]]):
        self.store, self.sizes, self.words = Store(uri), sizes, words
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def _part(self, part: int, what: str, kind: str, n: int) -> np.ndarray:
        return self.store.map(f"{what}-{part}", kind, n)

    def slots(self, keys: np.ndarray, checks: np.ndarray | None = None) -> np.ndarray:
        """Numbers from 0 over all parts; -1 for keys that are not of the set."""
        out = np.full(len(keys), -1, np.int64)
        if not len(keys) or not len(self.sizes):
            return out
        part = part_of(keys, len(self.sizes))
        order, edges = _grouped(part, len(self.sizes))
        for p in np.flatnonzero(np.diff(edges)):
            at = order[edges[p] : edges[p + 1]]
            n, own = self.sizes[p], keys[at]
            if not n:
                continue
            bits = self._part(p, "bits", "<u8", sum(self.words[p]))
            ranks = self._part(p, "ranks", "<u4", sum(self.words[p]))
            slot, left, start = np.full(len(own), -1, np.int64), np.arange(len(own)), 0
            for level, words in enumerate(self.words[p]):
                place = _place(own[left], level, words)
                word, bit = start + (place >> 6), (place & 63).astype(_U)
                value = bits[word]
                hit = (value >> bit) & _U(1) == 1
                before = np.bitwise_count(value[hit] & ((_U(1) << bit[hit]) - _U(1)))
                slot[left[hit]] = ranks[word[hit]] + before
                left = left[~hit]
                start += words
                if not len(left):
                    break
            found = np.flatnonzero(slot >= 0)
            same = self._part(p, "keys", "<u8", n)[slot[found]] == own[found]
            if checks is not None:
                same &= self._part(p, "checks", "<u8", n)[slot[found]] == checks[at[found]]
            found = found[same]
            out[at[found]] = slot[found] + self.base[p]
        return out

    def part_keys(self, part: int) -> np.ndarray:
        return np.array(self._part(part, "keys", "<u8", self.sizes[part]))

    def read(self, what: str, slots: np.ndarray) -> np.ndarray:
        """`keys` or `counts` at slots."""
        kind = "<u8" if what == "keys" else "<i8"
        out = np.zeros(len(slots), kind)
        part = np.searchsorted(self.base, slots, side="right") - 1
        for p in np.unique(part):
            some = part == p
            out[some] = self._part(int(p), what, kind, self.sizes[p])[slots[some] - self.base[p]]
        return out


def _grouped(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their parts, and where each part begins; negative parts come before."""
    part = part.astype(np.int16 if parts < 1 << 15 else np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(keys) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def _place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
    """A bit of a level for each key."""
    return ((mix(keys ^ _U(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)) & _U(0xFFFFFFFF)) * _U(64 * words) >> _U(32)).astype(np.int64)


def levels(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each level, the levels' bits, the bits set before each word, and the order of the keys by slot. Keys must differ."""
    sizes, bits, order = [], [], []
    left = np.arange(len(keys))
    while len(left):
        words = max(1, -(-2 * len(left) // 64))
        place = _place(keys[left], len(sizes), words)
        alone = np.bincount(place, minlength=64 * words) == 1
        bits.append(np.packbits(alone, bitorder="little").view("<u8"))
        stay = alone[place]
        order.append(left[stay][np.argsort(place[stay])])
        left = left[~stay]
        sizes.append(words)
    all_ = np.concatenate(bits) if bits else np.zeros(0, _U)
    return sizes, all_, (np.cumsum(np.bitwise_count(all_), dtype=np.int64) - np.bitwise_count(all_)).astype("<u4"), np.concatenate(order) if order else np.zeros(0, np.int64)


def build(rows: DataFrame, name: str, n: int, part_keys: int) -> Hash:
    """The hash of rows (key long, check long, count long) with n distinct keys. Writes files in the shared folder; a task that runs again writes the same ones."""
    parts = max(PARTS, -(-n // part_keys))
    uri = shared_folder(rows.sparkSession, name)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(part_of(key.view(_U), parts), pa.int32()), *b.columns], names=["part", "key", "check", "count"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(uri)
        for part, table in _runs(batches):
            keys, checks, counts = (table.column(k).to_numpy() for k in (1, 2, 3))
            keys = keys.view(_U)
            sizes, bits, ranks, order = levels(keys)
            for what, array in (("bits", bits), ("ranks", ranks), ("keys", keys[order]), ("checks", checks[order]), ("counts", counts[order])):
                store.save(f"{what}-{part}", array)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([sizes], pa.list_(pa.int64()))], names=["part", "n", "words"])

    ready = rows.select("key", "check", "count").mapInArrow(dealt, "part int, key long, check long, count long").repartition("part").sortWithinPartitions("part")
    made = {r.part: r for r in written(ready.mapInArrow(built, "part int, n long, words array<long>"), f"{name}-parts").collect()}  # one row for PART keys
    return Hash(uri, [made[p].n if p in made else 0 for p in range(parts)], [list(made[p].words) if p in made else [] for p in range(parts)])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of each value of the first column, which come one after another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        first = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if held and held[0].column(0)[0].as_py() != first[lo]:
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held).combine_chunks()


# ---- words


def _word_hashes(lang: str, words: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each word of a language."""
    head = lang.encode() + b"\x00"
    both = [xxhash.xxh3_128_intdigest(head + w, seed) for w in words]
    return np.array([x & (1 << 64) - 1 for x in both], _U), np.array([x >> 64 for x in both], _U)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, words in held.items():
            words.pop(_END, None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array([w.decode() for w in words], pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "f"])
        held.clear()

    for batch in slices(batches):
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(lang, Counter()).update(pieces(text))
        if sum(map(len, held.values())) > HELD // 8:
            yield from out()
    yield from out()


def _numbered(words: DataFrame, part_keys: int) -> tuple[Hash, int]:
    """A hash of the words (lang, word, f) whose 64-bit keys differ, and the seed that makes them differ."""
    for seed in range(20):

        def hashed(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [xxhash.xxh3_128_intdigest(x.encode() + b"\x00" + w.encode(), seed) for x, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                key, check = (np.array([(x >> k) & (1 << 64) - 1 for x in got], _U).view(np.int64) for k in (0, 64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(check), b.column(2)], names=["key", "check", "count"])

        keys = written(words.select("lang", "word", "f").mapInArrow(hashed, "key long, check long, count long"), "word-keys")
        n, distinct = keys.agg(F.count("*"), F.count_distinct("key")).first()
        if n == distinct:
            return build(keys, "words", n, part_keys), seed
    raise RuntimeError("no seed tells the words apart")


def _encoder(hash_: Hash, seed: int) -> Callable:
    """(lang, text) batches to (lang, ids): numbers from 1 of frequent words, 0 for others and between pieces and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Numbering, np.ndarray]] = {}
        for batch in slices(batches):
            words: dict[str, list[bytes]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = words.setdefault(lang, [])
                own += pieces(text)
                own.append(_END)
            out = []
            for lang, own in words.items():
                ids, numbers = known.get(lang) or (Numbering({_END: 0}), np.zeros(1, np.uint32))
                at = np.fromiter(map(ids.__getitem__, own), np.int64, len(own))
                if len(ids) > len(numbers):
                    new = list(islice(ids, len(numbers), None))
                    numbers = np.concatenate([numbers, (hash_.slots(*_word_hashes(lang, new, seed)) + 1).astype(np.uint32)])
                known[lang] = ids, numbers
                out.append(pack(numbers[at]))
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(out, pa.binary())], names=["lang", "ids"])
            if sum(len(x) for x, _ in known.values()) > HELD // 8:
                known.clear()

    return run


# ---- phrases


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two frequent words stand side by side, and the keys of these pairs."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    return at, ids[at].astype(_U) << _U(32) | ids[at + 1].astype(_U)


def _chunks(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[np.ndarray]:
    """Word numbers (or keys) of many rows; the words of each text end in a 0."""
    held, size = [], 0
    for batch in slices(batches, 16):
        for raw in batch.column(0).to_pylist():
            held.append(unpack(raw, kind))
            size += len(held[-1])
            if size > HELD // 4:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _keys(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[np.ndarray]:
    """Keys of all occurrences: of pairs, from word numbers, or as they are stored."""
    for chunk in _chunks(batches, kind):
        yield _pairs(chunk)[1] if kind == "<u4" else chunk


def _seen(kind: str, least: int) -> Callable:
    """Keys with occurrences, as many as prove that they are frequent at most: added up over all tasks, they reach `least` where all occurrences do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(keys), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(np.minimum(n[part], least).astype(np.int32))], names=["key", "n"])

        held, size = [], 0
        for keys in _keys(batches, kind):
            held.append(keys)
            size += len(keys)
            if size > HELD:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    return run


_ARRAYS = "part int, task int, slots binary, counts binary"


def _array_row(part: int, task: int, counts: np.ndarray) -> pa.RecordBatch:
    """The slots that have counts, as steps from one to the next, and the counts."""
    some = np.flatnonzero(counts)
    values = [[part], [task], [pack(np.diff(some, prepend=0).astype("<u4"))], [pack(counts[some].astype("<i8"))]]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "task", "slots", "counts"])


def _bincount(hash_: Hash, kind: str, triples: bool) -> Callable:
    """Occurrences by slot, in one array for each part that a task meets. With triples, also the keys of three words (a slot and a word) of which both pairs have slots, as rows of no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        arrays: dict[int, np.ndarray] = {}
        for chunk in _chunks(batches, kind):
            at, keys = _pairs(chunk) if kind == "<u4" else (None, chunk)
            slots = hash_.slots(keys)
            order, edges = _grouped(np.searchsorted(hash_.base, slots, side="right") - 1, len(hash_.sizes))
            for p in np.flatnonzero(np.diff(edges)).tolist():
                if p not in arrays:
                    arrays[p] = np.zeros(hash_.sizes[p], np.int64)
                arrays[p] += np.bincount(slots[order[edges[p] : edges[p + 1]]] - hash_.base[p], minlength=hash_.sizes[p])
                if sum(map(len, arrays.values())) > SLOTS:
                    yield from (_array_row(q, task, a) for q, a in arrays.items())
                    arrays.clear()
            if triples:
                on = np.flatnonzero((at[1:] == at[:-1] + 1) & (slots[1:] >= 0) & (slots[:-1] >= 0))
                if len(on):
                    three = slots[on].astype(_U) << _U(32) | chunk[at[on] + 2].astype(_U)
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((-1, pa.int32()), (task, pa.int32()), (pack(three), pa.binary()), (b"", pa.binary()))], names=["part", "task", "slots", "counts"])
        yield from (_array_row(q, task, a) for q, a in arrays.items())

    return run


def _summed(sizes: list[int]) -> Callable:
    """One row for the rows of a part that come one after another; the array held is that of one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = -1, None
        for batch in slices(batches, 16):
            for p, slots, counts in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if p != part:
                    if total is not None:
                        yield _array_row(part, 0, total)
                    part, total = p, np.zeros(sizes[p], np.int64)
                total[np.cumsum(unpack(slots, "<u4"), dtype=np.int64)] += unpack(counts, "<i8")
        if total is not None:
            yield _array_row(part, 0, total)

    return run


def _tree(arrays: DataFrame, sizes: list[int]) -> DataFrame:
    """The sum of all arrays of a part: of FAN tasks each, then of those sums."""
    level = arrays.withColumn("task", (F.col("task") / FAN).cast("int"))
    level = level.repartition("part", "task").sortWithinPartitions("part", "task").mapInArrow(_summed(sizes), _ARRAYS)
    return level.repartition("part").sortWithinPartitions("part").mapInArrow(_summed(sizes), _ARRAYS)


def _sums(hash_: Hash) -> Callable:
    """Keys and counts of a part's slots; the counts become the hash's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for p, slots, counts in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                n = np.zeros(hash_.sizes[p], np.int64)
                n[np.cumsum(unpack(slots, "<u4"), dtype=np.int64)] = unpack(counts, "<i8")
                hash_.store.save(f"counts-{p}", n)
                yield pa.RecordBatch.from_arrays([pa.array(hash_.part_keys(p).view(np.int64)), pa.array(n)], names=["key", "count"])

    return run


def _counted(rows: DataFrame, kind: str, name: str, least: int, part_keys: int) -> tuple[Hash, DataFrame, DataFrame]:
    """The frequent phrases of one level: their hash with counts, and a table (key, count) of them. rows: word numbers or keys. The third: keys of three words, from word numbers."""
    candidates = written(rows.mapInArrow(_seen(kind, least), "key long, n int").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key", F.lit(0).cast("long").alias("check"), F.lit(0).cast("long").alias("count")), f"{name}-candidates")
    hash_ = build(candidates, name, candidates.count(), part_keys)
    if hash_.base[-1] >= (1 << 32) - 1:
        raise ValueError("more than 4 x 10^9 frequent words or phrases of two words")
    arrays = written(rows.mapInArrow(_bincount(hash_, kind, kind == "<u4"), _ARRAYS), f"{name}-arrays")
    found = written(_tree(arrays.where("part >= 0"), hash_.sizes).mapInArrow(_sums(hash_), "key long, count long"), f"{name}-frequent")
    return hash_, found, arrays.where("part < 0").select(F.col("slots").alias("keys"))


_PHRASE = "w1 long, w2 long, w3 long, a long, l long, r long, l2 long, r2 long, head long, tail long"


def _cut_pairs(words: Hash, pairs: Hash) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False).view(_U)
            x, y = ((key >> _U(s) & _U(0xFFFFFFFF)).astype(np.int64) - 1 for s in (32, 0))
            none = pa.nulls(len(key), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), none, b.column(1), pa.array(words.read("counts", x)), pa.array(words.read("counts", y)), none, none, pa.array(pairs.slots(key)), none], names=[c.split()[0] for c in _PHRASE.split(", ")])

    return run


def _cut_triples(words: Hash, pairs: Hash) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False).view(_U)
            head, z = (key >> _U(32)).astype(np.int64), (key & _U(0xFFFFFFFF)).astype(np.int64) - 1
            first = pairs.read("keys", head)
            x, y = ((first >> _U(s) & _U(0xFFFFFFFF)).astype(np.int64) - 1 for s in (32, 0))
            tail = pairs.slots((y + 1).astype(_U) << _U(32) | (z + 1).astype(_U))
            columns = [x, y, z, None, words.read("counts", x), pairs.read("counts", tail), pairs.read("counts", head), words.read("counts", z), head, tail]
            yield pa.RecordBatch.from_arrays([b.column(1) if c is None else pa.array(c) for c in columns], names=[c.split()[0] for c in _PHRASE.split(", ")])

    return run


def _score(a: Column, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * wide(a) * wide(a), wide(left) * wide(right))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, first: int = FIRST, part_keys: int = PART) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of two or three words of each language that keep together most.

    a, l, r: occurrences of the phrase and of its parts before and after its weakest cut; n: of all words of the language; score:
    floor(1,000,000 a a / (l r)). A phrase occurs at least `least` times, within a piece (texts are cut at . , ; : ! ? and line ends). A phrase
    within a longer one of at least half its occurrences is left out. A null lang is `und`, a null text empty; repeated rows count as often
    as they are there; an empty table, or one without frequent phrases, gives no row. Ties go by a, then by the phrase's bytes. Words are told
    apart by 128 bits of hash; more than 4 x 10^9 frequent words or phrases of two words raise an error."""
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = written(own.mapInArrow(_count_words, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f")), "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counts.where(F.col("f") >= least)
    words, seed = _numbered(frequent, part_keys)
    if words.base[-1] >= (1 << 32) - 1:
        raise ValueError("more than 4 x 10^9 frequent words or phrases of two words")
    encoded = written(own.mapInArrow(_encoder(words, seed), "lang string, ids binary"), "word-numbers")

    pairs, found2, threes = _counted(encoded.select("ids"), "<u4", "pairs", least, part_keys)
    _, found3, _ = _counted(threes, "<u8", "triples", least, part_keys)

    triples = written(found3.mapInArrow(_cut_triples(words, pairs), _PHRASE), "triples")
    longer = triples.select(F.explode(F.array("head", "tail")).alias("head"), F.col("a").alias("longer")).groupBy("head").agg(F.max("longer").alias("longer"))
    alone = found2.mapInArrow(_cut_pairs(words, pairs), _PHRASE).join(longer, "head", "left").where("longer IS NULL OR 100 * longer < 50 * a").drop("longer")
    both = triples.unionByName(alone)
    s1, s2 = _score(F.col("a"), F.col("l"), F.col("r")), _score(F.col("a"), F.col("l2"), F.col("r2"))
    second = F.coalesce(s2 < s1, F.lit(False))
    scored = both.select("w1", "w2", "w3", "a", F.when(second, F.col("l2")).otherwise(F.col("l")).alias("l"), F.when(second, F.col("r2")).otherwise(F.col("r")).alias("r"), F.when(second, s2).otherwise(s1).alias("score"))

    numbers = written(frequent.select("lang", "word").mapInArrow(_numbers(words, seed), "lang string, word string, id long"), "words-by-number")
    named = scored.join(numbers.select("lang", F.col("word").alias("x"), F.col("id").alias("w1")), "w1")
    top = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    named = named.withColumn("place", F.rank().over(top)).where(F.col("place") <= first).drop("place")  # those of equal score and a stay until their words are known
    for k in ("2", "3"):
        named = named.join(numbers.select(F.col("id").alias(f"w{k}"), F.col("word").alias("y" + k)), f"w{k}", "left")
    named = named.withColumn("phrase", F.concat_ws(" ", "x", "y2", "y3"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _numbers(words: Hash, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, own = b.column(0).to_pylist(), [w.encode() for w in b.column(1).to_pylist()]
            ids = np.zeros(len(own), np.int64)
            for lang in set(langs):
                some = [k for k, x in enumerate(langs) if x == lang]
                ids[some] = words.slots(*_word_hashes(lang, [own[k] for k in some], seed))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids)], names=["lang", "word", "id"])

    return run
