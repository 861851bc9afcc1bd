"""Exact top-k inner products by columnar branch and bound.

The query set is taken in blocks of QUERY_BYTES; each block is broadcast and held against all rows in one pass. A task
keeps the k best of each query, of those only that reach the k-th best among SEEDS rows that the driver has scored: of a table of
n rows, tasks send about k x n / SEEDS rows a query at most, however many tasks there are. A batch of candidates lies in vertical layout (one row of the array for a dimension) with
the dimensions that carry most of the queries' mass first; scores grow one block of dimensions at a time, and after each
block a pair survives only if its partial score plus the product of the two remaining norms can still reach the query's
k-th best. Candidates without surviving pairs are compacted away; when few pairs are left, they alone go on.

Scores are exact integers: floor(256 x) of every component, with whole-number arithmetic wherever a double could round.

Defined results: null vectors, and those with null or non-finite components (or ones that are no longer finite times
256), take no part, nor do rows without an id; only vectors with as many components as the query are its candidates;
all rows with the query's own id count as its own; a query id on several rows takes the least vector of them, a
candidate id that occurs on several rows takes part with each; scores beyond a long saturate; ties go to smaller ids."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, slices, written

QUERY_BYTES = 24 << 20
SEEDS = 2048
CANDIDATE_ROWS = 4096
_AT_ONCE = 256
_DIMS = 16
_EXACT = float(1 << 52)
_LONG = (1 << 63) - 1


def scaled(vectors: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * vectors.astype(np.float64))


class Best:
    """The k best candidates of each query so far: higher scores first, then smaller ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.k, n = ids, k, len(ids)
        self.floor = np.full(n, -np.inf) if floor is None else floor  # no score below it is among the best
        self.vectors = vectors
        self.score = np.full((n, k), -np.inf)
        self.found = np.full((n, k), _LONG, np.int64)
        self.order = np.argsort(-(vectors**2).sum(axis=0), kind="stable") if vectors.size else np.arange(vectors.shape[1])
        self.q = np.ascontiguousarray(vectors[:, self.order])
        self.most = float(np.abs(vectors).max(initial=0))

    def offer(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Pairs: index of the query, id of the candidate, score."""
        keep = ids != self.ids[q]
        q, ids, scores = q[keep], ids[keep], scores[keep]
        if not len(q):
            return
        some = np.unique(q)
        q = np.concatenate([q, np.repeat(some, self.k)])
        ids = np.concatenate([ids, self.found[some].ravel()])
        scores = np.concatenate([scores, self.score[some].ravel()])
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.searchsorted(q, some)[:, None] + np.arange(self.k)[None, :]
        self.score[some], self.found[some] = scores[first], ids[first]

    def search(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Takes a batch of candidates, already scaled."""
        ids, x = _without_copies(ids, x, self.k)
        if x.shape[1] and self.most * float(np.abs(x).max(initial=0)) * x.shape[1] >= _EXACT:
            self._whole_numbers(ids, x)
            return
        x = np.ascontiguousarray(x[:, self.order])
        for part in (slice(0, _AT_ONCE), slice(_AT_ONCE, None)):  # the first candidates set the bounds for the rest
            if len(ids[part]):
                for at in range(0, len(self.ids), _AT_ONCE):
                    self._bounded(slice(at, min(at + _AT_ONCE, len(self.ids))), ids[part], x[part])

    def _bounded(self, some: slice, ids: np.ndarray, x: np.ndarray) -> None:
        q = self.q[some]
        n, d = q.shape
        least = np.maximum(self.score[some, -1], self.floor[some])[:, None]
        columns = np.ascontiguousarray(x.T)
        score = np.zeros((n, len(ids)))
        rest_q, rest_x = (q**2).sum(axis=1), (x**2).sum(axis=1)
        pairs = None
        for at in range(0, d, _DIMS):
            part = slice(at, min(d, at + _DIMS))
            rest_q = rest_q - (q[:, part] ** 2).sum(axis=1)
            rest_x = rest_x - (columns[part] ** 2).sum(axis=0)
            if pairs is None:
                score += q[:, part] @ columns[part]
                if part.stop == d:
                    break
                bound = score + np.sqrt(np.maximum(rest_q, 0))[:, None] * np.sqrt(np.maximum(rest_x, 0))[None, :] * (1 + 1e-9) + 1e-6
                alive = bound >= least
                left = np.count_nonzero(alive)
                if left * 16 < alive.size:
                    i, j = np.nonzero(alive)
                    pairs, partial = (i, j), score[i, j]
                    continue
                stay = alive.any(axis=0)
                if np.count_nonzero(stay) * 10 < 9 * len(stay):
                    columns, score, rest_x, ids = np.ascontiguousarray(columns[:, stay]), score[:, stay], rest_x[stay], ids[stay]
            else:
                i, j = pairs
                partial = partial + np.einsum("pd,dp->p", q[i, part], columns[part][:, j])
                bound = partial + np.sqrt(np.maximum(rest_q[i], 0) * np.maximum(rest_x[j], 0)) * (1 + 1e-9) + 1e-6
                alive = bound >= least[i, 0]
                pairs, partial = (i[alive], j[alive]), partial[alive]
        if pairs is None:
            pairs = np.nonzero(score >= least)
            partial = score[pairs]
        i, j = pairs
        self.offer(i + some.start, ids[j], partial)

    def _whole_numbers(self, ids: np.ndarray, x: np.ndarray) -> None:
        """For components so large that doubles could round."""
        rows = [[int(v) for v in r] for r in x]
        for i, q in enumerate(self.vectors):
            q = [int(v) for v in q]
            got = [max(-_LONG - 1, min(_LONG, sum(map(int.__mul__, q, r)))) for r in rows]
            best = sorted((-s, int(v)) for s, v in [*zip(got, ids.tolist(), strict=True), *((s, v) for s, v in zip(self._exact(i), self.found[i].tolist(), strict=True) if s is not None)] if v != self.ids[i])[: self.k]
            self._put(i, best)

    def _exact(self, i: int) -> list:
        self.score = self.score.astype(object)
        return [None if s == -np.inf else int(s) for s in self.score[i]]

    def _put(self, i: int, best: list) -> None:
        for r in range(self.k):
            self.score[i, r], self.found[i, r] = (-best[r][0], best[r][1]) if r < len(best) else (-np.inf, _LONG)

    def result(self) -> pa.RecordBatch:
        i, r = np.nonzero((self.score != -np.inf).astype(bool))
        score = [int(s) for s in self.score[i, r]]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i], pa.int64()), pa.array(self.found[i, r], pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])


def _without_copies(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors, k rows at most of each of the k + 1 smallest ids: without those of any one id, the k best are still there."""
    if x.shape[1] == 0:
        group = np.zeros(len(ids), np.int64)
    else:
        group = np.unique(np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, 8 * x.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, group))
    g, i, at = group[order], ids[order], np.arange(len(order))
    new_group = np.diff(g, prepend=-1) != 0
    new_id = new_group | (np.diff(i, prepend=0) != 0)
    copy = at - np.maximum.accumulate(np.where(new_id, at, 0))
    nth = np.cumsum(new_id)
    nth -= np.maximum.accumulate(np.where(new_group, nth, 0))
    keep = np.sort(order[(copy < k) & (nth <= k)])
    return ids[keep], x[keep]


def floors(ids: np.ndarray, vectors: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among some candidates; -inf where there are fewer, or where doubles could round."""
    out = np.full(len(ids), -np.inf)
    if len(seed_ids) < k or not seeds.shape[1] or float(np.abs(vectors).max(initial=0)) * float(np.abs(seeds).max(initial=0)) * seeds.shape[1] >= _EXACT:
        return out
    for at in range(0, len(ids), _AT_ONCE):
        some = slice(at, at + _AT_ONCE)
        score = vectors[some] @ seeds.T
        score[ids[some, None] == seed_ids[None, :]] = -np.inf
        out[some] = np.partition(score, len(seed_ids) - k, axis=1)[:, len(seed_ids) - k]
    return out


def _by_length(batch: pa.RecordBatch):
    """(components, ids, scaled vectors) of a batch's rows that take part."""
    ids, vectors = batch.column(0), batch.column(1)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        x = flat[((ends[rows] - d)[:, None] + np.arange(d)[None, :])] if d else np.zeros((len(rows), 0))
        yield int(d), ids.to_numpy(zero_copy_only=False)[rows], scaled(x)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of `vectors` with the highest scores for each row of `queries`."""
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        return df.where(F.col("vec_id").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) <= F.lit(1.7e308 / 256))), F.lit(False)))

    rows = clean(vectors)
    asked = written(clean(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "asked")
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, math.ceil(n * 8 * max(1, width) / QUERY_BYTES))
    sample = {d: (i, x) for b in rows.limit(SEEDS).toArrow().combine_chunks().to_batches() for d, i, x in _by_length(b)}
    folder = shared_folder(spark, "topk")
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow().combine_chunks().to_batches()
        by_length = {d: (i, x) for part in block for d, i, x in _by_length(part)}
        none = np.zeros(0, np.int64)
        shared = spark.sparkContext.broadcast({d: (i, x, floors(i, x, *sample.get(d, (none, np.zeros((0, d)))), k)) for d, (i, x) in by_length.items()})

        def run(batches, shared=shared):
            best = {d: Best(i, x, k, floor) for d, (i, x, floor) in shared.value.items()}
            for batch in slices(batches, CANDIDATE_ROWS):
                for d, ids, x in _by_length(batch):
                    if d in best:
                        best[d].search(ids, x)
            for x in best.values():
                yield x.result()

        rows.mapInArrow(run, "query_id long, vec_id long, score long").write.mode("append").parquet(folder)
        shared.unpersist()
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(folder)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
