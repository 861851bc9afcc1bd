"""Interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark, kept as sorted hash arrays that workers memory-map.

Tables, each in at most 2^FILE_BITS files by the leading bits of a uniform 64-bit key, sorted by key:
  words    key = hash of the word, value = its count; a word's number is its place over all shards
  bigrams  key = a one-to-one mix of (number before, number), value = its count
  numbers  per word number: how many distinct words follow it once, twice, more often, and how many precede it
  trigrams and pairs (order 3 only): key = a one-to-one mix of (place of the first two words' bigram, number of the third), value = its
           count; and what numbers says of words, said of bigrams by their places. Of a bigram then counts how many words precede it, or,
           where it begins a text, how often it occurs; numbers is made from these counts and also holds their sum for each first word
Counting tasks combine their own n-grams first and send each shard (of SHARD_TEXT of text) one packed block; the shards' tasks
merge the blocks and write their part of the order into the shared folder (a rerun task writes the same bytes under a new name and
moves them in place). Where there are more shards than files, a task for each file joins its shards end to end, a piece at a time.
Only the list of files goes to the driver. Numbers of followers and predecessors are added up FAN blocks at a time. Scoring tasks map
the files, at most OPEN at once; the sorted distinct keys of a batch are looked up file by file. Where the shared folder is not a
local path, a worker copies a file to map it, and the copy goes with the map.

A word is known by 64 bits, a random multiple of each of its bytes by place, summed and mixed: two given words share them with a
chance of about 2^-60, and would then count as one word; of the at most 2^32 words, hardly a pair will.

A text is its words, then one end token; the context of the first token is a begin mark. Discounts are the usual three,
from counts of counts of each order, and each is held between 0 and its count. The distribution of continuations is interpolated with
a uniform share over the distinct tokens and one unknown word.

Defined results: a null text is empty: one end token. Every row gives one row; a null id counts as '' when rows are
dealt to training. With no training text each token has probability 1 / (V + 1) with V = 0."""

from __future__ import annotations

import math
import os
import shutil
import tempfile
import uuid
from collections import OrderedDict
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, id_bucket, shared_folder, slices

#: Tokens that a task gathers before it combines and sends them.
GATHER = 3_000_000
#: Bytes of training text for each shard.
SHARD_TEXT = 16 << 20
#: Word numbers for each task that adds up their statistics.
PART = 1 << 18
BATCH = 512
#: Files of a table, as a power of 2; files that a worker maps at once; blocks of statistics that are added up at once.
FILE_BITS = 6
OPEN = 160
FAN = 32
#: Words of the longest n-grams, unless told otherwise; parts that the bigrams' statistics are added up in, at most (each of PART or more).
ORDER = 2
PAIR_PARTS = 1024
_SLAB = 4 << 20

_U = np.uint64
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_M1, _M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers whose leading bits are uniform."""
    x = (x ^ (x >> _U(30))) * _U(_M1)
    x = (x ^ (x >> _U(27))) * _U(_M2)
    return x ^ (x >> _U(31))


def unmix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31)) ^ (x >> _U(62))
    x = x * _U(pow(_M2, -1, 1 << 64))
    x = x ^ (x >> _U(27)) ^ (x >> _U(54))
    x = x * _U(pow(_M1, -1, 1 << 64))
    return x ^ (x >> _U(30)) ^ (x >> _U(60))


def _pair(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two word numbers of a bigram's key."""
    pair = unmix(keys)
    return (pair >> _U(32)).astype(np.int64), (pair & _U(0xFFFFFFFF)).astype(np.int64)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
END = int(mix(np.array([0x0E0D], _U))[0])

_FACTORS = [np.zeros(0, _U)]


def _factors(n: int) -> np.ndarray:
    """Odd random numbers, one for each place in a word."""
    if len(_FACTORS[0]) < n:
        _FACTORS[0] = mix((np.arange(max(n, 1024, 2 * len(_FACTORS[0])), dtype=_U) + _U(1)) * _U(_STEP)) | _U(1)
    return _FACTORS[0]


def _slab_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in data, and how many there are up to each of ends (the texts' ends, ascending)."""
    n = len(data)
    word = ~_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    before[ends[ends < n]] = False
    start = np.flatnonzero(word & ~before)
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    after[ends[(ends > 0)] - 1] = False
    size = np.flatnonzero(word & ~after) + 1 - start
    if not len(start):
        return np.zeros(0, _U), np.searchsorted(start, ends)
    first = np.cumsum(size) - size  # among the bytes of words alone
    terms = _VALUE[data[word]]
    terms *= _factors(int(size.max()))[np.arange(len(terms)) - np.repeat(first, size)]
    return mix(np.add.reduceat(terms, first) ^ (size.astype(_U) * _U(_STEP))), np.searchsorted(start, ends)


def token_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end tokens included, and where each text's tokens end."""
    pieces, counts, slab, size = [], [], [], 0

    def flush():
        nonlocal slab, size
        if slab:
            h, upto = _slab_words(np.frombuffer(b"".join(slab), np.uint8), np.cumsum([len(x) for x in slab]))
            pieces.append(h)
            counts.extend(np.diff(upto, prepend=0).tolist())
        slab, size = [], 0

    owner = []
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        at = 0
        while True:  # a text longer than a slab is cut at white space
            stop = len(raw)
            if stop - at > _SLAB:
                cut = max(raw.rfind(c, at, at + _SLAB) for c in (b" ", b"\n", b"\t", b"\r"))
                stop = cut + 1 if cut >= at else stop
            slab.append(raw[at:stop])
            owner.append(i)
            size += stop - at
            if size >= _SLAB:
                flush()
            at = stop
            if at >= len(raw):
                break
    flush()
    words = np.concatenate(pieces) if pieces else np.zeros(0, _U)
    per_text = np.bincount(np.array(owner, np.int64), weights=counts, minlength=len(texts)).astype(np.int64) if texts else np.zeros(0, np.int64)
    ends = np.cumsum(per_text + 1)
    out = np.empty(len(words) + len(texts), _U)
    is_end = np.zeros(len(out), bool)
    is_end[ends - 1] = True
    out[is_end] = END
    out[~is_end] = words
    return out, ends


# ---- files in the shared folder


class Store:
    """A folder that all workers reach: a local path, or one of a file system that Arrow knows."""

    def __init__(self, uri: str):
        self.uri = uri
        self.local = uri[len("file:") :].replace("//", "/", 1).replace("//", "/") if uri.startswith("file:") else uri if uri.startswith("/") else None

    @contextmanager
    def writer(self, name: str):
        """A file that is there, whole, when the block has ended."""
        own = f"{name}.{uuid.uuid4().hex}"
        if self.local:
            os.makedirs(os.path.dirname(f"{self.local}/{name}"), exist_ok=True)
            with open(f"{self.local}/{own}", "wb") as f:
                yield f
            os.replace(f"{self.local}/{own}", f"{self.local}/{name}")
            return
        fs, path = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(os.path.dirname(f"{path}/{name}"), recursive=True)
        with fs.open_output_stream(f"{path}/{own}") as f:
            yield f
        fs.move(f"{path}/{own}", f"{path}/{name}")

    def save(self, name: str, array: np.ndarray) -> None:
        with self.writer(name) as f:
            if len(array):
                f.write(memoryview(np.ascontiguousarray(array)).cast("B"))

    def reader(self, name: str):
        if self.local:
            return open(f"{self.local}/{name}", "rb")
        fs, path = pafs.FileSystem.from_uri(self.uri)
        return fs.open_input_stream(f"{path}/{name}")

    def map(self, name: str, kind: str, n: int) -> np.ndarray:
        """A file as an array; the OPEN files used last stay mapped."""
        if not n:
            return np.zeros(0, kind)
        key = (self.uri, name)
        if key in _MAPS:
            _MAPS.move_to_end(key)
            return _MAPS[key]
        if self.local:
            got = np.memmap(f"{self.local}/{name}", kind, "r", shape=(n,))
        else:
            with self.reader(name) as f, tempfile.NamedTemporaryFile(prefix="pathwright-model-") as copy:  # the map outlives the name
                shutil.copyfileobj(f, copy, 1 << 22)
                copy.flush()
                got = np.memmap(copy.name, kind, "r", shape=(n,))
        _MAPS[key] = got
        while len(_MAPS) > OPEN:
            _MAPS.popitem(last=False)
        return got


_MAPS: OrderedDict[tuple[str, str], np.ndarray] = OrderedDict()


def pack(array: np.ndarray) -> bytes:
    """Sorted or small numbers, compressed: the bytes of one significance lie together."""
    raw = np.ascontiguousarray(array)
    return zstandard.ZstdCompressor(level=1).compress(raw.view(np.uint8).reshape(len(raw), -1).T.tobytes()) if len(raw) else b""


def unpack(raw: bytes, kind: str) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    return np.frombuffer(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1).T.tobytes(), kind)


def _smallest(n: np.ndarray) -> np.ndarray:
    top = int(n.max(initial=0))
    return n.astype(next(k for k in ("u1", "u2", "u4", "u8") if top <= np.iinfo(k).max))


_BLOCKS = "shard int, keys binary, counts binary, kind string"


def _blocks(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row for each shard that sorted keys fall into."""
    edges = np.searchsorted(keys >> _U(64 - bits), np.arange((1 << bits) + 1, dtype=_U)) if bits else np.array([0, len(keys)])
    some = np.flatnonzero(np.diff(edges))
    counts = _smallest(counts)
    delta = [np.diff(keys[edges[s] : edges[s + 1]], prepend=_U(0)) for s in some]
    return pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.array([pack(d) for d in delta], pa.binary()), pa.array([pack(counts[edges[s] : edges[s + 1]]) for s in some], pa.binary()), pa.array([counts.dtype.str] * len(some), pa.string())],
        names=["shard", "keys", "counts", "kind"],
    )


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.cumsum(unpack(x, "<u8"), dtype=_U) for x in table["keys"].to_pylist()])
    counts = np.concatenate([unpack(x, k).astype(np.uint64) for x, k in zip(table["counts"].to_pylist(), table["kind"].to_pylist(), strict=True)])
    return _added(keys, counts)


def _added(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their counts (1 each if none are given)."""
    if counts is None:
        keys, n = np.unique(keys, return_counts=True)
        return keys, n.astype(_U)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Table:
    """Files of sorted keys with counts; find() gives places over all files, -1 where a key is missing."""

    def __init__(self, store: Store, name: str, bits: int, sizes: list[int], kinds: list[str]):
        self.store, self.name, self.bits, self.sizes, self.kinds = store, name, bits, sizes, kinds
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def _file(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        return self.store.map(f"{self.name}-{s}.keys", "<u8", self.sizes[s]), self.store.map(f"{self.name}-{s}.counts", self.kinds[s], self.sizes[s])

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts at places in ascending order."""
        keys, counts = np.zeros(len(places), _U), np.zeros(len(places), np.int64)
        edges = np.searchsorted(places, self.base)
        for s in np.flatnonzero(np.diff(edges)):
            some = slice(edges[s], edges[s + 1])
            keys[some], counts[some] = (x[places[some] - self.base[s]] for x in self._file(int(s)))
        return keys, counts

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts of sorted distinct keys."""
        place, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        if not len(keys):
            return place, count
        edges = np.searchsorted(keys >> _U(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=_U)) if self.bits else np.array([0, len(keys)])
        for s in np.flatnonzero(np.diff(edges)):
            if self.sizes[s]:
                have, n = self._file(int(s))
                some = slice(edges[s], edges[s + 1])
                at = np.minimum(np.searchsorted(have, keys[some]), len(have) - 1)
                hit = have[at] == keys[some]
                place[some] = np.where(hit, at + self.base[s], -1)
                count[some] = np.where(hit, n[at], 0)
        return place, count


def _gathered(batches, of_batch, bits: int):
    """Combines keys of many batches before they are sent."""
    held, n = [], 0
    for batch in batches:
        keys = of_batch(batch)
        held.append(keys)
        n += len(keys)
        if n >= GATHER:
            yield _blocks(*_added(np.concatenate(held), None), bits)
            held, n = [], 0
    if n:
        yield _blocks(*_added(np.concatenate(held), None), bits)


_FILES = "shard int, n long, kind string, total long, c1 long, c2 long, c3 long, c4 long, part int, ids binary, stats binary"


def _row(**some) -> pa.Table:
    kinds = {"shard": pa.int32(), "n": pa.int64(), "kind": pa.string(), "total": pa.int64(), "c1": pa.int64(), "c2": pa.int64(), "c3": pa.int64(), "c4": pa.int64(), "part": pa.int32(), "ids": pa.binary(), "stats": pa.binary()}
    return pa.table({k: pa.array([some.get(k)], t) for k, t in kinds.items()})


def _joined(store: Store, name: str, shift: int):
    """The function that joins the shards of one file, given their rows of the manifest, and gives the file's row."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["shard", "n", "kind"]).to_pylist(), key=lambda r: r["shard"])
        s, kind = rows[0]["shard"] >> shift, max((r["kind"] for r in rows), key=lambda k: np.dtype(k).itemsize)
        for ending, to in (("keys", "<u8"), ("counts", kind)):
            with store.writer(f"{name}-{s}.{ending}") as out:
                for r in rows:
                    have = np.dtype("<u8" if ending == "keys" else r["kind"])
                    with store.reader(f"shards-{name}/{name}-{r['shard']}.{ending}") as f:
                        while piece := f.read(have.itemsize << 19):
                            out.write(np.frombuffer(piece, have).astype(to).tobytes())
        return _row(shard=s, n=sum(r["n"] for r in rows), kind=kind)

    return run


def _write(store: Store, folder: str, name: str, table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    s = table["shard"][0].as_py()
    keys, counts = _merged(table)
    small = _smallest(counts)
    store.save(f"{folder}{name}-{s}.keys", keys.astype("<u8"))
    store.save(f"{folder}{name}-{s}.counts", small)
    c = [int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)]
    return _row(shard=s, n=len(keys), kind=small.dtype.str, total=int(counts.sum()), c1=c[0], c2=c[1], c3=c[2], c4=c[3]), keys, counts


def discounts(c1: int, c2: int, c3: int, c4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times."""
    y = c1 / (c1 + 2 * c2) if c1 else 0.5
    ahead = (c2 / c1 if c1 else 0.5), (c3 / c2 if c2 else 0.5), (c4 / c3 if c3 else 0.5)
    return tuple(min(k, max(0.0, k - (k + 1) * y * r)) for k, r in zip((1, 2, 3), ahead, strict=True))


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    edges = np.flatnonzero(np.diff(values)) + 1
    return list(zip([0, *edges], [*edges, len(values)], strict=True)) if len(values) else []


def _stat_rows(shard: int, part: int, kinds: list[tuple[np.ndarray, np.ndarray | None]]) -> list[pa.Table]:
    """Sums for each number: kinds are columns, each the numbers it counts and what each adds (None: 1). One row a part."""
    ids, where = np.unique(np.concatenate([k for k, _ in kinds]), return_inverse=True)
    stats, at = np.zeros((len(ids), len(kinds)), np.uint64), 0
    for column, (own, add) in enumerate(kinds):
        here = where[at : at + len(own)]
        if add is None:
            stats[:, column] = np.bincount(here, minlength=len(ids))
        else:
            np.add.at(stats[:, column], here, add.astype(_U))
        at += len(own)
    return [
        _row(shard=shard, part=int(ids[i] // part), ids=pack(np.diff(ids[i:j] - ids[i] // part * part, prepend=0).astype("<u4")), stats=pack(np.ascontiguousarray(stats[i:j]).astype("<u8")))
        for i, j in _runs(ids // part)
    ]


def _followers(first: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, None]]:
    return [(first[some], None) for some in (counts == 1, counts == 2, counts >= 3)]


class Model:
    """The manifest of a trained model; tables are mapped by whoever uses it."""

    def __init__(self, words: Table, bigrams: Table, store: Store, n_tokens: int, n_texts: int, part: int, bigram_d: tuple, word_d: tuple, continuations: int, spread: float):
        self.words, self.bigrams, self.store = words, bigrams, store
        self.n_tokens, self.n_texts, self.part = n_tokens, n_texts, part
        self.bigram_d, self.word_d, self.continuations, self.spread = bigram_d, word_d, continuations, spread
        self.types = int(words.base[-1])
        self.trigrams, self.trigram_d, self.pair_part = None, None, 0

    def statistics(self, ids: np.ndarray, pairs: bool = False) -> np.ndarray:
        """Rows of (followers once, twice, more; predecessors; of words at order 3 also the sum of counts) by sorted word numbers below V + 1 (V is the begin mark), or by sorted places of bigrams."""
        name, part = ("pairs", self.pair_part) if pairs else ("numbers", self.part)
        width = 5 if self.trigrams and not pairs else 4
        out = np.zeros((len(ids), width), np.float64)
        for i, j in _runs(ids // part):
            p = int(ids[i] // part)
            rows = self.store.map(f"{name}-{p}", "<u8", part * width).reshape(-1, width)
            out[i:j] = rows[ids[i:j] - p * part]
        return out

    def score(self, texts: list) -> dict[str, np.ndarray]:
        h, ends = token_hashes(texts)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        distinct, where = np.unique(h, return_inverse=True)
        number, count = self.words.find(distinct)
        v = self.types
        known = np.flatnonzero(number >= 0)  # numbers grow with the keys
        stats = np.zeros((len(distinct) + 1, 5 if self.trigrams else 4))
        stats[known] = self.statistics(number[known])
        if self.n_texts:
            stats[-1] = self.statistics(np.array([v]))[0]
        total = np.append(count, self.n_texts).astype(np.float64)
        d1, d2, d3 = self.word_d
        seen = stats[:-1, 3]
        lower = (seen - _discount(seen, d1, d2, d3) + self.spread / (v + 1)) / self.continuations if self.continuations else np.full(len(distinct), 1 / (v + 1))
        before = np.roll(where, 1)
        before[starts] = len(distinct)  # the begin mark
        numbers = np.append(number, v).astype(np.int64)
        a, b = numbers[before], numbers[where]
        both = (a >= 0) & (b >= 0)
        keys, at = np.unique(mix((a[both].astype(_U) << _U(32)) | b[both].astype(_U)), return_inverse=True)
        c = np.zeros(len(h))
        places, occur = self.bigrams.find(keys)
        c[both] = occur[at]
        context = total[before]
        if self.trigrams:
            place, raw = np.full(len(h), -1, np.int64), c.copy()
            place[both] = places[at]
            found, own = np.unique(place, return_inverse=True)  # -1, if at all, comes first
            of_pair = np.zeros((len(found), 4))
            of_pair[found >= 0] = self.statistics(found[found >= 0], pairs=True)
            of_pair = of_pair[own]
            c = np.where(a == v, raw, of_pair[:, 3])
            context = stats[before, 4]
        d1, d2, d3 = self.bigram_d
        left = (stats[:, 0] * d1 + stats[:, 1] * d2 + stats[:, 2] * d3)[before]
        low = lower[where]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(context > 0, (c - _discount(c, d1, d2, d3) + left * low) / context, low)
        if self.trigrams and len(h):
            context, left, place = (np.roll(x, 1, axis=0) for x in (raw, of_pair, place))
            context[starts] = 0
            some = (context > 0) & (b >= 0)
            keys, at = np.unique(_triple(place[some], b[some], v), return_inverse=True)
            c = np.zeros(len(h))
            c[some] = self.trigrams.find(keys)[1][at]
            d1, d2, d3 = self.trigram_d
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(context > 0, (c - _discount(c, d1, d2, d3) + (left[:, 0] * d1 + left[:, 1] * d2 + left[:, 2] * d3) * p) / context, p)
        base = np.log10((count[where] + 1) / (self.n_tokens + v + 1))
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
        return {"n_tokens": np.diff(ends, prepend=0), "n_known": add((count[where] > 0).astype(np.int64)), "base_score": add(base), "score": add(np.log10(p))}


def _discount(c: np.ndarray, d1: float, d2: float, d3: float) -> np.ndarray:
    return np.where(c >= 3, d3, np.where(c == 2, d2, np.where(c == 1, d1, 0.0)))


def _triple(place: np.ndarray, third: np.ndarray, v: int) -> np.ndarray:
    return mix((place.astype(_U) << _U(v.bit_length())) | third.astype(_U))


def train(texts: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """The model of the texts. Order 3 needs the bits of a bigram's place and of a word's number to be 64 at most, and raises an error beyond."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark, part = texts.sparkSession, PART
    df = texts.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size, n_texts = df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    bits = max(0, math.ceil(math.log2(max(1, size / SHARD_TEXT))))
    folder = shared_folder(spark, "ngrams")
    store = Store(f"{folder}/arrays")
    inside = lambda name: f"shards-{name}/" if bits > FILE_BITS else ""

    def stage(blocks: DataFrame, reduce, name: str, *by: str) -> DataFrame:
        blocks.groupBy(*(by or ("shard",))).applyInArrow(reduce, _FILES).write.option("compression", "none").parquet(f"{folder}/{name}")
        return spark.read.schema(_FILES).parquet(f"{folder}/{name}")

    def table(name: str, rows: DataFrame) -> tuple[Table, dict]:
        shards = rows.where("n is not null")
        sums = shards.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "c1", "c2", "c3", "c4")]).first().asDict()
        if bits > FILE_BITS:
            shards = stage(shards.withColumn("to", F.shiftright("shard", bits - FILE_BITS)), _joined(store, name, bits - FILE_BITS), f"{name}-files", "to")
        got = {r["shard"]: r for r in shards.select("shard", "n", "kind").collect()}  # one row a file
        if bits > FILE_BITS:
            delete(spark, f"{folder}/arrays/shards-{name}")
        files = [got.get(s) for s in range(1 << min(bits, FILE_BITS))]
        return Table(store, name, min(bits, FILE_BITS), [r["n"] if r else 0 for r in files], [r["kind"] if r else "u1" for r in files]), sums

    def count_words(batches):
        return _gathered(slices(batches, BATCH), lambda b: token_hashes(b.column(0).to_pylist())[0], bits)

    words, sums = table("words", stage(df.mapInArrow(count_words, _BLOCKS), lambda t: _write(store, inside("words"), "words", t)[0], "words"))
    n_tokens = sums["total"]
    v = int(words.base[-1])
    if v >= (1 << 32) - 1:
        raise ValueError("more distinct words than 32-bit numbers")
    known = spark.sparkContext.broadcast(words)

    def pairs_of(batch) -> np.ndarray:
        h, ends = token_hashes(batch.column(0).to_pylist())
        distinct, where = np.unique(h, return_inverse=True)
        b = known.value.find(distinct)[0][where].astype(_U)
        a = np.roll(b, 1)
        a[np.concatenate([[0], ends[:-1]])] = v
        return mix((a << _U(32)) | b)

    def merge_pairs(t: pa.Table) -> pa.Table:
        row, keys, counts = _write(store, inside("bigrams"), "bigrams", t)
        if order > 2:
            return row
        a, b = _pair(keys)
        return pa.concat_tables([row, *_stat_rows(row["shard"][0].as_py(), part, [*_followers(a, counts), (b, None)])])

    found = stage(df.mapInArrow(lambda batches: _gathered(slices(batches, BATCH), pairs_of, bits), _BLOCKS), merge_pairs, "bigrams")
    bigrams, sums = table("bigrams", found)
    bigram_d = discounts(*[sums[f"c{k}"] for k in (1, 2, 3, 4)])

    def added_up(blocks: DataFrame, left: int, part: int, width: int, name: str, reduce) -> DataFrame:
        """Adds up the blocks of each part, FAN of `left` at a time; reduce(part, sums) gives the rows of the result."""

        def added(t: pa.Table) -> np.ndarray:
            total = np.zeros((part, width), np.uint64)
            for ids, stats in zip(t["ids"], t["stats"], strict=True):
                total[np.cumsum(unpack(ids.as_py(), "<u4"), dtype=np.int64)] += unpack(stats.as_py(), f"V{8 * width}").view("<u8").reshape(-1, width)
            return total

        def merge_parts(t: pa.Table) -> pa.Table:
            total = added(t)
            ids = np.flatnonzero(total.any(axis=1))
            return pa.table({"part": t["part"][:1].cast(pa.int32()), "shard": t["to"][:1].cast(pa.int32()), "ids": pa.array([pack(np.diff(ids, prepend=0).astype("<u4"))], pa.binary()), "stats": pa.array([pack(np.ascontiguousarray(total[ids]).astype("<u8"))], pa.binary())})

        def add_up(t: pa.Table) -> pa.Table:
            p, total = t["part"][0].as_py(), added(t)
            store.save(f"{name}-{p}", total.astype("<u8"))
            return reduce(p, total)

        parts = blocks.where("part is not null").select("part", "shard", "ids", "stats")
        while left > FAN:
            parts = parts.withColumn("to", F.floor(F.col("shard") / FAN).cast("int")).groupBy("part", "to").applyInArrow(merge_parts, "part int, shard int, ids binary, stats binary")
            left = -(-left // FAN)
        parts.groupBy("part").applyInArrow(add_up, _FILES).write.option("compression", "none").parquet(f"{folder}/{name}")
        return spark.read.schema(_FILES).parquet(f"{folder}/{name}")

    def of_counts(counts: np.ndarray, **more) -> pa.Table:
        return _row(n=int(np.count_nonzero(counts)), total=int(counts.sum()), **{f"c{k}": int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)}, **more)

    left, width, trigrams, pair_part = 1 << bits, 4, None, 0
    if order == 3:
        width, n_pairs = 5, int(bigrams.base[-1])
        if n_pairs.bit_length() + v.bit_length() > 64:
            raise ValueError("too many bigrams and words for trigrams in 64 bits")
        pair_part = max(part, -(-n_pairs // PAIR_PARTS))
        n_parts = -(-n_pairs // pair_part)
        pairs_known = spark.sparkContext.broadcast(bigrams)

        def triples_of(batch) -> np.ndarray:
            h, ends = token_hashes(batch.column(0).to_pylist())
            distinct, where = np.unique(h, return_inverse=True)
            b = known.value.find(distinct)[0][where].astype(_U)
            a, starts = np.roll(b, 1), np.concatenate([[0], ends[:-1]])
            a[starts] = v
            keys, at = np.unique(mix((a << _U(32)) | b), return_inverse=True)
            inner = np.ones(len(h), bool)
            inner[starts] = False
            return _triple(np.roll(pairs_known.value.find(keys)[0][at], 1)[inner], b[inner], v)

        def merge_triples(t: pa.Table) -> pa.Table:
            row, keys, counts = _write(store, inside("trigrams"), "trigrams", t)
            triple = unmix(keys)
            place, third = (triple >> _U(v.bit_length())).astype(np.int64), triple & _U((1 << v.bit_length()) - 1)
            ids, at = np.unique(place, return_inverse=True)
            second = _pair(pairs_known.value.at(ids)[0])[1][at]
            later, at = np.unique(mix((second.astype(_U) << _U(32)) | third), return_inverse=True)
            return pa.concat_tables([row, *_stat_rows(row["shard"][0].as_py(), pair_part, [*_followers(place, counts), (pairs_known.value.find(later)[0][at], None)])])

        def of_pairs(p: int, total: np.ndarray) -> pa.Table:
            places = np.arange(p * pair_part, min((p + 1) * pair_part, n_pairs))
            keys, raw = pairs_known.value.at(places)
            a, b = _pair(keys)
            counts = np.where(a == v, raw, total[: len(places), 3].astype(np.int64))
            return pa.concat_tables([of_counts(counts, shard=p), *_stat_rows(p, part, [*_followers(a, counts), (b, None), (a, counts)])])

        triples = stage(df.mapInArrow(lambda batches: _gathered(slices(batches, BATCH), triples_of, bits), _BLOCKS), merge_triples, "trigrams")
        trigrams, sums = table("trigrams", triples)
        trigram_d = discounts(*[sums[f"c{k}"] for k in (1, 2, 3, 4)])
        every = spark.range(n_parts).select(F.col("id").cast("int").alias("part"), F.lit(0).alias("shard"), F.lit(b"").alias("ids"), F.lit(b"").alias("stats"))  # also parts without a trigram
        found = added_up(triples.select(every.columns).union(every), left, pair_part, 4, "pairs", of_pairs)
        left = max(1, n_parts)
        bigram_d = discounts(*[found.where("n is not null").agg(F.coalesce(F.sum(f"c{k}"), F.lit(0))).first()[0] for k in (1, 2, 3, 4)])
    sums = added_up(found, left, part, width, "numbers", lambda p, total: of_counts(total[:, 3], part=p)).select("part", "n", "total", "c1", "c2", "c3", "c4").collect()
    c = [sum(r[f"c{k}"] for r in sums) for k in (1, 2, 3, 4)]
    word_d = discounts(*c)
    more = sum(r["n"] for r in sums) - c[0] - c[1]
    spread = word_d[0] * c[0] + word_d[1] * c[1] + word_d[2] * more
    model = Model(words, bigrams, store, n_tokens, n_texts, part, bigram_d, word_d, sum(r["total"] for r in sums), spread)
    if order == 3:
        model.trigrams, model.trigram_d, model.pair_part = trigrams, trigram_d, pair_part
    return model


def score_texts(docs: DataFrame, held_out: int = 2, folds: int = 7, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row; learned from the rows that are not held out."""
    spark = docs.sparkSession
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = train(df.where(id_bucket("doc_id", folds) != held_out), order=order)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, BATCH):
            got = shared.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(got.values(), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]], names=["doc_id", *got])

    kind = df.schema["doc_id"].dataType.simpleString()
    scored = df.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (id_bucket("doc_id", folds) == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
