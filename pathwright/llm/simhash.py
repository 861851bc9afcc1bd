"""SimHash near-duplicates: fingerprints linked at 2 or fewer differing bits, found with vantage-point trees.

1. A fingerprint for each row (XXH64 of word shingles, seed 42, bitwise majority), kept as a table in the shared folder.
2. Equal fingerprints become one row; all that follows works on distinct fingerprints. A fingerprint's node is its smallest doc_id, or,
   if it has none, a number above all doc_ids.
3. A vantage-point tree over a bounded sample deals fingerprints to shards. Each has one home shard and visits the
   others that the triangle bound does not rule out: a link crosses a boundary by at most 2. A shard at which more than SHARD_ROWS
   are at home is split again by a tree over a sample of its own, made where its rows are, until none is larger, and no further: each split
   makes a fingerprint visit more shards (about shards^0.45 of them, if fingerprints are random). Only fingerprints
   that lie closer together than any radius parts stay together: a few bits apart, there are not many that differ. The tree has an entry a shard.
4. A shard's visitors are dealt to blocks of about VISITORS, each of which gets the shard's residents too. A block searches its
   residents with a tree of its own, and gives a spanning forest of the links found, so that dense groups cost no more rows than they
   have members.
5. Components by repeated min-hooking and pointer jumping on tables; nothing of it goes to the driver.

Defined results: null and wordless texts have fingerprint zero and are linked like any other; rows with one doc_id are
one node, whatever their texts; a null doc_id takes part through its text, and links what is near it, but is never a component_id
(null if nothing else is in reach)."""

from __future__ import annotations

import pickle
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_scan, drop_table, fresh, slices, written

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints that the driver takes to plan the shards.
PLAN_SAMPLE = 8192
#: Fingerprints at home in one shard at most, visitors of one of its blocks on average, and shards for parallel work where fewer would do.
SHARD_ROWS = 250_000
VISITORS = 1_000_000
SHARDS, LEAST_ROWS = 64, 2048
LEAF = 64
_CHUNK = 1 << 16


def hashes_of(text: str | None) -> list[int]:
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return []
    xx = xxhash.xxh64_intdigest
    joined = b" ".join(w)
    if len(w) < SHINGLE:
        return [xx(joined, SEED)]
    ends = list(accumulate(map(len, w)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    return [xx(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :], strict=False)]


def fingerprint(text: str | None) -> int:
    """Unsigned; bit k is 1 if it is set in over half of the hashes."""
    h = hashes_of(text)
    if not h:
        return 0
    ones = np.zeros(64, np.int64)
    a = np.array(h, "<u8")
    for i in range(0, len(a), _CHUNK):
        ones += np.unpackbits(a[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(a), bitorder="little").view("<u8")[0])


def _scan_fingerprints(texts: list) -> list[pa.Array]:
    return [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), pa.int64())]


# ---- vantage-point trees over arrays of uint64


def _distance(a: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ v)


def _split(points: np.ndarray, rng: np.random.Generator, tries: int = 6) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that put the fewest points near the boundary, of splits that are not lopsided."""
    best = None
    some = points if len(points) <= 1024 else rng.choice(points, 1024, replace=False)
    for v in rng.choice(points, min(tries, len(points)), replace=False):
        d = np.sort(_distance(some, v))
        for q in (0.35, 0.5, 0.65):
            mu = int(d[int(q * (len(d) - 1))])
            inside = np.count_nonzero(d <= mu) / len(d)
            if not 0.1 < inside < 0.9:
                continue
            near = np.count_nonzero((d > mu - RADIUS) & (d <= mu + RADIUS)) / len(d)
            if near > 0.9:  # both sides would hold nearly all
                continue
            cost = np.log1p(near) / -(inside * np.log(inside) + (1 - inside) * np.log(1 - inside))
            if best is None or cost < best[0]:
                best = (cost, v, mu)
    return best and best[1:]


def plan_shards(sample: np.ndarray, shards: int) -> list:
    """A tree as nested lists: [vantage, radius, inside, outside], or None for a leaf."""
    rng = np.random.default_rng(7)

    def grow(points: np.ndarray, want: int):
        cut = _split(points, rng) if want > 1 and len(points) >= 8 else None
        if cut is None:
            return None
        inside = _distance(points, cut[0]) <= cut[1]
        k = min(want - 1, max(1, round(want * inside.mean())))
        return [cut[0], cut[1], grow(points[inside], k), grow(points[~inside], want - k)]

    return grow(sample, shards)


def number_leaves(node, grown: dict[int, list] | None = None) -> tuple:
    """The tree with its leaves numbered from 0, those in `grown` replaced by trees; and how many leaves it has."""
    count = 0

    def walk(x):
        nonlocal count
        if isinstance(x, list):
            return [x[0], x[1], walk(x[2]), walk(x[3])]
        if grown and x in grown:
            return walk(grown[x])
        count += 1
        return count - 1

    return walk(node), count


def route(node, points: np.ndarray, index: np.ndarray, home: np.ndarray, out: list) -> None:
    """out gets (shard, index of points, whether the shard is home) for every shard that a point must reach."""
    if not len(index):
        return
    if not isinstance(node, list):
        out.append((node, index, home))
        return
    v, mu, inner, outer = node
    d = _distance(points[index], v).astype(np.int16)
    into, outof = d <= mu + RADIUS, d > mu - RADIUS
    route(inner, points, index[into], home[into] & (d[into] <= mu), out)
    route(outer, points, index[outof], home[outof] & (d[outof] > mu), out)


def _link(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of the pairs a, b in root, an array of labels that stays flat."""
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def local_forest(points: np.ndarray, home: np.ndarray, among: bool = True) -> np.ndarray:
    """The component label (an index) of each point, where links have at least one end at home; just one, if not `among` residents."""
    root = np.arange(len(points))
    rng = np.random.default_rng(11)

    def search(residents: np.ndarray, queries: np.ndarray) -> None:
        if not len(queries) or not len(residents):
            return
        cut = _split(points[residents], rng, 3) if len(residents) > LEAF else None
        if cut is None:
            for i in range(0, len(queries), 4096):
                for j in range(0, len(residents), 512):
                    q, r = queries[i : i + 4096], residents[j : j + 512]
                    x, y = np.nonzero(np.bitwise_count(points[q][:, None] ^ points[r][None, :]) <= RADIUS)
                    _link(root, q[x], r[y])
            return
        dr = _distance(points[residents], cut[0])
        dq = _distance(points[queries], cut[0]).astype(np.int16)
        search(residents[dr <= cut[1]], queries[dq <= cut[1] + RADIUS])
        search(residents[dr > cut[1]], queries[dq > cut[1] - RADIUS])

    search(np.flatnonzero(home), np.arange(len(points)) if among else np.flatnonzero(~home))
    return root


# ---- on tables


def _dealt(distinct: DataFrame, tree, visits: bool = True) -> DataFrame:
    """shard, fp, node, home of every fingerprint and shard that it must reach, or that it is at home in."""
    shared = distinct.sparkSession.sparkContext.broadcast(tree)

    def deal(batches):
        for batch in slices(batches, 1 << 14):
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            nodes = batch.column(1).to_numpy(zero_copy_only=False)
            out: list = []
            route(shared.value, points, np.arange(len(points)), np.ones(len(points), bool), out)
            if not visits:
                out = [(shard, index[home], home[home]) for shard, index, home in out]
            if out:
                index = np.concatenate([x[1] for x in out])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([x[0] for x in out], np.int32), [len(x[1]) for x in out])), pa.array(points[index].view(np.int64)), pa.array(nodes[index]), pa.array(np.concatenate([x[2] for x in out]))], names=["shard", "fp", "node", "home"])

    return distinct.select("fp", "node").mapInArrow(deal, "shard int, fp long, node long, home boolean")


def _blocks(distinct: DataFrame, tree) -> DataFrame:
    """shard, block, fp, node, home: the rows of _dealt, visitors in one block of their shard and residents in all."""
    rows = _dealt(distinct, tree)
    if distinct.count() <= VISITORS:
        return rows.withColumn("block", F.lit(0))
    sizes = written(rows.groupBy("shard").agg(F.ceil(F.count_if(~F.col("home")) / VISITORS).cast("int").alias("blocks")).where("blocks > 1"), "blocks")
    number = F.coalesce("blocks", F.lit(1))
    own = F.when(F.col("home"), F.sequence(F.lit(0), number - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp", F.lit(2)), number).cast("int")))
    return rows.join(F.broadcast(sizes), "shard", "left").select("shard", F.explode(own).alias("block"), "fp", "node", "home")  # a row for VISITORS rows at least


def _planner(parts: dict[int, int]):
    """The function from a sample of a shard to its tree for so many parts."""

    def grown(t: pa.Table) -> pa.Table:
        shard = t["shard"][0].as_py()
        points = np.sort(t["fp"].to_numpy().view(np.uint64))
        return pa.table({"shard": pa.array([shard], pa.int32()), "tree": pa.array([pickle.dumps(plan_shards(points, parts[shard]))], pa.binary())})

    return grown


def shard_tree(distinct: DataFrame):
    """The tree that deals fingerprints to shards with at most SHARD_ROWS residents, but for those that no radius parts."""
    n, spark = distinct.count(), distinct.sparkSession
    sample = distinct.select("fp").orderBy(F.xxhash64("fp")).limit(PLAN_SAMPLE).toArrow()["fp"].to_numpy().view(np.uint64)
    most, fixed = SHARD_ROWS, set()  # fixed: leaves, by a fingerprint of theirs, that cannot be split
    tree, _ = number_leaves(plan_shards(sample, max(1, min(SHARDS, n // LEAST_ROWS), -(-2 * n // most))))
    while n > most:
        sizes = _dealt(distinct, tree, visits=False).groupBy("shard").agg(F.count("*").alias("own"), F.min("fp").alias("least"))
        large = [r for r in sizes.where(F.col("own") > most).collect() if r["least"] not in fixed]  # one row a large shard
        if not large:
            break
        shares = spark.createDataFrame([(r["shard"], 2 * PLAN_SAMPLE / r["own"]) for r in large], "shard int, share double")
        parts = {r["shard"]: min(64, -(-2 * r["own"] // most)) for r in large}
        drawn = _dealt(distinct, tree, visits=False).join(F.broadcast(shares), "shard").where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 30)) < F.col("share") * (1 << 30))

        trees = {r["shard"]: pickle.loads(r["tree"]) for r in drawn.select("shard", "fp").groupBy("shard").applyInArrow(_planner(parts), "shard int, tree binary").collect()}
        fixed |= {r["least"] for r in large if trees.get(r["shard"]) is None}
        tree, _ = number_leaves(tree, {k: v for k, v in trees.items() if v is not None})
    return tree


def _edges(distinct: DataFrame, tree) -> DataFrame:
    """(v, p), p < v: a spanning forest of each block's links, between the nodes of fingerprints. Links among residents are found in a shard's first block."""

    def forest(table: pa.Table) -> pa.Table:
        points, nodes = table["fp"].to_numpy().view(np.uint64), table["node"].to_numpy()
        order = np.argsort(nodes, kind="stable")
        points, nodes = points[order], nodes[order]
        root = local_forest(points, table["home"].to_numpy()[order], table["block"][0].as_py() == 0)
        v, p = nodes, nodes[root]
        linked = v != p
        return pa.table({"v": pa.array(v[linked], pa.int64()), "p": pa.array(p[linked], pa.int64())})

    return _blocks(distinct, tree).groupBy("shard", "block").applyInArrow(forest, "v long, p long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, p) with p the smallest node that v reaches, for every v that is not the smallest itself. edges: p < v."""
    now = written(edges, "edges")
    while True:
        least = F.min("p").over(Window.partitionBy("v"))
        seen = now.withColumn("m", least)
        parent = now.groupBy("v").agg(F.min("p").alias("up")).withColumnRenamed("v", "m")
        jumped = seen.join(parent, "m", "left")
        pairs = F.array(
            F.struct(F.col("v").alias("v"), F.coalesce("up", "m").alias("p"), F.col("up").isNotNull().alias("moved")),
            F.struct(F.greatest("p", "m").alias("v"), F.least("p", "m").alias("p"), F.lit(True).alias("moved")),
        )
        then = jumped.select(F.explode(F.filter(pairs, lambda x: x["v"] != x["p"])).alias("x")).select("x.*")
        then = written(then.groupBy("v", "p").agg(F.max("moved").alias("moved")), "edges")
        moved = then.where("moved").limit(1).count()
        drop_table(now)
        now = then
        if not moved:
            return now.select("v", "p")


def _linked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, root, component_id) of each fingerprint; root is the component's smallest node."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(append_scan(df, "text", [T.StructField("fp", T.LongType())], lambda: _scan_fingerprints).select("doc_id", "fp"), "fingerprints")
    most = rows.agg(F.max("doc_id")).first()[0] or 0
    above = F.when(F.lit(most < (1 << 62)), F.lit(most)).otherwise(F.raise_error(F.lit("doc_ids from 2^62 leave no numbers for rows without one")).cast("long"))
    by_print = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    distinct = written(by_print.withColumn("node", F.coalesce("rep", above + F.lit(1) + F.monotonically_increasing_id())), "distinct")
    edges = _edges(distinct, shard_tree(distinct))
    # rows with one doc_id and several texts
    twice = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id")
    twice = written(twice, "repeats")
    if twice.limit(1).count():
        several = written(rows.join(twice, "doc_id", "left_semi").distinct().join(distinct.select("fp", "node"), "fp").select("doc_id", "node"), "several")
        least = several.groupBy("doc_id").agg(F.min("node").alias("p"))
        edges = edges.unionByName(several.join(least, "doc_id").where("node <> p").select(F.col("node").alias("v"), "p"))
    found = components(edges)
    named = distinct.join(found, distinct["node"] == found["v"], "left").select("fp", F.coalesce("p", "node").alias("root"))
    return rows, named.withColumn("component_id", F.when(F.col("root") <= most, F.col("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of each row of docs."""
    rows, named = _linked(docs, id_col, text_col)
    return rows.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id; of several rows with it, or of a component without any, the one
    of the least text by hash. The others' ids are a table that Spark broadcasts if it is small, and else joins by shuffle."""
    rows, named = _linked(docs, id_col, text_col)
    found = written(rows.join(named, "fp", "left").select("doc_id", "component_id"), "components")
    gone = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    key, own = fresh(docs, "pw_gone"), F.col(id_col).cast("long")
    kept = docs.join(gone.select(F.col("doc_id").alias(key)), own == F.col(key), "left_anti")
    twice = written(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key)), "repeats")
    first = lambda df, by: df.groupBy(by).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(F.col(text_col).cast("string"))).alias("row")).select("row.*")
    if twice.limit(1).count():
        same = own == F.col(key)
        kept = kept.join(twice, same, "left_anti").unionByName(first(kept.join(twice, own == F.col(key)), key))
    if found.where("doc_id IS NULL").limit(1).count() == 0:
        return kept
    at = fresh(docs, "pw_fp")
    nameless = append_scan(docs.where(own.isNull()), text_col, [T.StructField(at, T.LongType())], lambda: _scan_fingerprints)
    alone = nameless.join(named.where("component_id IS NULL").select(F.col("fp").alias(at), F.col("root").alias(key)), at)
    return kept.where(own.isNotNull()).unionByName(first(alone, key))
