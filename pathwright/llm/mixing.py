"""Mixing sources to target weights: soft domain membership and nonnegative rates by constrained least squares.

A softmax classifier, fitted by the driver on a bounded sample of labelled rows (about SAMPLE_ROWS of them, of texts up to SAMPLE_CHARS characters; VOCABULARY words, and beginnings of words
that three words of a text share, which tell what a stem's many compounds do not), gives each document its posterior of the domains `high`, `low` and `toxic` of the labels table. A document with n tokens and
posterior p puts n * p into the domains' totals. Of all rates r >= 0 whose expected totals are the targets, those are taken
that change least, by the sum of n (r - 1)^2, by projected gradient steps of the least squares of the totals' error: from rates 1 on, each
step takes the error's share from every rate, and rates below 0 count as 0. As a step's change of a rate is p times one vector over the
domains, the rates before projection are p . x, and no state is kept for documents: each pass is one aggregate over them (the error, and the
second derivatives over those with a rate, by which the next step is scaled). Steps are accelerated by momentum, which starts anew when it
leads away, and shortened where the error would not fall, until the totals are the targets to SETTLED. Column expressions only.

If that does not settle within PASSES passes (no rates may reach the targets), the squared error is minimised together with a
small multiple of the squared distance of the rates from 1, which RIDGES lower in turn, and a warning tells the shares reached.

Defined results: a null text has no tokens, and the posterior of an empty text. Without labelled rows, the posterior is
uniform. Domains without mass cannot reach their target; the others still do. Every row gives one row."""

from __future__ import annotations

import json
import warnings
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, written

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.80, "low": 0.19, "toxic": 0.01}
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 50_000
VOCABULARY = 300
#: Letters of a beginning, and how many distinct words of a text must share it.
BEGINNING = 5
SHARED = 3
#: Passes of one search at most, the error (a share of all tokens) that ends it, and what keeps its equations solvable.
PASSES = 40
SETTLED = 1e-7
TINY = 1e-9
RIDGES = (1e-2, 1e-3, 1e-4, 1e-5, 1e-6)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shape(text: Column) -> list[Column]:
    """Shares of symbols and of capitals."""
    n = F.greatest(F.length(text), F.lit(1))
    return [F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s.,]+", "")) / n, F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / n]


def _sample(docs: DataFrame, labels: DataFrame) -> list:
    kinds = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"), F.coalesce(F.col("toxic").cast("int"), F.lit(0)).alias("toxic")).where("label_id is not null and (quality is not null or toxic = 1)")
    n = kinds.count()
    draw = lambda c: F.pmod(F.xxhash64(F.lit("mix"), F.col(c)), F.lit(1 << 30))
    limit = (1 << 30) if n <= SAMPLE_ROWS else int((1 << 30) * SAMPLE_ROWS / n)
    kinds = kinds.where(draw("label_id") < limit).groupBy("label_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    texts = docs.where((draw("doc_id") < limit) & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", F.array_distinct(_words(F.col("text"))).alias("words"), *[c.alias(f"shape{i}") for i, c in enumerate(_shape(F.col("text")))])
    got = texts.join(kinds, texts["doc_id"] == kinds["label_id"])
    return got.orderBy(F.xxhash64("doc_id"), F.hash("words")).limit(2 * SAMPLE_ROWS).drop("doc_id", "label_id").collect()


def _features(words: list[str]) -> set[str]:
    """Distinct words, and the beginnings that enough of them share, marked by a sign that no word has."""
    begun = Counter(w[:BEGINNING] for w in words)
    return {*words, *("^" + b for b, n in begun.items() if n >= SHARED)}


class Classifier:
    def __init__(self, words: dict[str, list[float]], shape: np.ndarray, bias: np.ndarray):
        self.words, self.shape, self.bias = words, shape, bias

    def posterior(self, words: Column, shape: Column) -> Column:
        """array<double> over DOMAINS, from distinct words and an array of shape features."""
        known = F.from_json(F.lit(json.dumps(list(self.words))), "array<string>")
        weights = F.from_json(F.lit(json.dumps(self.words)), "map<string,array<double>>")
        start = F.array(*[sum((F.get(shape, F.lit(i)) * F.lit(float(v)) for i, v in enumerate(self.shape[:, d])), F.lit(float(self.bias[d]))) for d in range(len(DOMAINS))])
        stems = [v[1:] for v in self.words if v.startswith("^")]

        def shared(begun: Column) -> Column:
            often = F.filter(F.array_distinct(begun), lambda b: F.size(F.filter(begun, lambda x: x == b)) >= SHARED)
            return F.transform(often, lambda b: F.concat(F.lit("^"), b))

        begun = F.filter(F.transform(words, lambda w: F.left(w, F.lit(BEGINNING))), lambda b: b.isin(stems)) if stems else None
        found = F.array_intersect(words, known) if begun is None else F.concat(F.array_intersect(words, known), let(begun, shared))
        z = F.aggregate(found, start, lambda acc, w: F.zip_with(acc, F.element_at(weights, w), lambda a, b: a + b))

        def softmax(z: Column) -> Column:
            return let(F.array_max(z), lambda top: let(F.transform(z, lambda x: F.exp(x - top)), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda x: x / total))))

        return let(z, softmax)


def fit(rows: list) -> Classifier:
    k = len(DOMAINS)
    if not rows:
        return Classifier({}, np.zeros((2, k)), np.zeros(k))
    y = np.array([2 if r["toxic"] else 0 if r["quality"] else 1 for r in rows])
    seen: dict[str, np.ndarray] = {}
    for r, d in zip(rows, y, strict=True):
        for w in _features(r["words"]):
            seen.setdefault(w, np.zeros(k))[d] += 1
    size = np.maximum(1, np.bincount(y, minlength=k)).astype(float)
    least = max(3, len(rows) // 400)
    scored = []
    for w, c in seen.items():
        if c.sum() >= least:
            share = (c + 0.5) / (size + 1)
            scored.append((-float(np.max(np.abs(np.log(share / ((c.sum() - c + 0.5) / (size.sum() - size + 1)))) * np.sqrt(c.sum()))), w))
    words = [w for _, w in sorted(scored)[:VOCABULARY]]
    place = {w: i for i, w in enumerate(words)}
    x = np.zeros((len(rows), len(words) + 3))
    for i, r in enumerate(rows):
        x[i, [place[w] for w in _features(r["words"]) if w in place]] = 1
        x[i, -3:] = min(1.0, r["shape0"] * 10), min(1.0, r["shape1"] * 5), 1
    w = np.zeros((x.shape[1], k))
    w[-1] = np.log(size / size.sum())
    target = np.eye(k)[y]
    squares = np.zeros_like(w)
    for _ in range(300):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (p - target) / len(rows) + 2e-4 * w
        squares += g * g
        w -= 0.3 * g / np.sqrt(squares + 1e-12)
    w = w.round(6)
    return Classifier({v: w[i].tolist() for v, i in place.items()}, w[-3:-1], w[-1])


def memberships(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, p (array over DOMAINS) of each row, as a table in the shared folder."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return _members(df, fit(_sample(df, labels)))


def _members(df: DataFrame, model: Classifier) -> DataFrame:
    return written(df.select("doc_id", _member(model, F.col("text")).alias("x")).select("doc_id", "x.*"), "memberships")


def _member(model: Classifier, text: Column) -> Column:
    """struct<n_tokens, p> of a text."""

    def of(text: Column) -> Column:
        shape = _shape(text)
        shape = F.array(F.least(shape[0] * 10, F.lit(1.0)), F.least(shape[1] * 5, F.lit(1.0)))
        return let(_words(text), lambda w: let(shape, lambda s: F.struct(F.size(w).cast("long").alias("n_tokens"), let(F.array_distinct(w), lambda d: model.posterior(d, s)).alias("p"))))

    return let(F.coalesce(text, F.lit("")), of)


def _rate(p: Column, x: np.ndarray | None) -> Column:
    if x is None:
        return F.lit(1.0)
    return F.greatest(F.lit(0.0), sum((F.get(p, F.lit(d)) * F.lit(float(x[d])) for d in range(1, len(DOMAINS))), F.get(p, F.lit(0)) * F.lit(float(x[0]))))


def fit_rates(members: DataFrame, targets: dict[str, float]) -> np.ndarray | None:
    """The vector x of the rates max(0, p . x); null without tokens."""
    k = len(DOMAINS)
    n, p = F.col("n_tokens").cast("double"), [F.get("p", F.lit(d)) for d in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    tokens = members.agg(F.sum(n)).first()[0]
    if not tokens:
        return None
    want = np.array([targets.get(d, 0.0) for d in DOMAINS], float)
    want /= max(1e-12, want.sum())

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value, gradient and second derivatives, a token."""
        rate, used = F.col("r"), F.when(F.col("r") > 0, n).otherwise(0.0)
        got = members.withColumn("r", _rate(F.col("p"), x)).agg(F.sum(n * rate * rate), *[F.sum(n * rate * v) for v in p], *[F.sum(used * p[i] * p[j]) for i, j in pairs]).first()
        got = np.array(got, float) / tokens
        h = np.zeros((k, k))
        for (i, j), v in zip(pairs, got[k + 1 :], strict=True):
            h[i, j] = h[j, i] = v
        return got[0] / 2 - x @ want, got[1 : k + 1] - want, h

    return _descend(at, np.ones(k), want)


def _descend(at, start: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Projected gradient steps on the rates until their totals are the targets; if they never are, what RIDGES lead to, each the rates that balance the error against that much of the squared distance from 1.

    The rates before projection are p . x: a step takes p . (S^-1 e) from them, for the error e of the totals. at(x) gives a value that falls as the error does, the error, and the second derivatives."""
    passes = 0

    def search(x: np.ndarray, ridge: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        nonlocal passes

        def look(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
            nonlocal passes
            passes += 1
            value, error, h = at(x)
            return value + ridge / 2 * float((x - start) @ (x - start)), error + ridge * (x - start), h + ridge * np.eye(len(x)), error

        reached = lambda here: min(np.abs(here[1]).sum(), np.abs(here[3]).sum()) <= SETTLED
        last, speed, shorter = passes + most, 1.0, 1.0
        y, here = x, look(x)
        whole = here[2]
        while passes < last and not reached(here):
            # the curvature of the documents in use, more of that of all documents the longer steps fail
            step = np.linalg.solve(shorter * (here[2] + (1e-3 * (shorter - 1) + TINY) * whole) + TINY * np.eye(len(x)), here[1])
            new, there = y - step, look(y - step)
            # the slope along the step tells what the value cannot where its change is below its last digit
            if there[0] > here[0] - 0.25 * here[1] @ step and abs(there[1] @ step) > 0.5 * abs(here[1] @ step):
                shorter *= 4
                continue
            shorter = max(1.0, shorter / 4)
            faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
            ahead = (speed - 1) / faster
            if there[1] @ (new - x) > 0:  # the momentum leads away
                ahead, faster = 0.0, 1.0
            y, x, speed = new + ahead * (new - x), new, faster
            here = there if not ahead or reached(there) else look(y)
            if reached(there):
                y = new
        return y, here[3]

    x, error = search(start, 0.0, PASSES)
    if np.abs(error).sum() <= SETTLED:
        return x
    x = start
    for ridge in RIDGES:
        x, error = search(x, ridge, PASSES)
        if np.abs(error).sum() <= SETTLED:
            return x
    shares = ", ".join(f"{d} {v + w:.6f} for {w:.6f}" for d, v, w in zip(DOMAINS, error, want, strict=True))
    warnings.warn(f"the rates do not reach the targets (after {passes} passes: {shares})", stacklevel=3)
    return x


def shares(members: DataFrame, x: np.ndarray | None) -> list[float] | None:
    """Each domain's tokens at these rates, as a share of the tokens there are; null without tokens."""
    n = F.col("n_tokens").cast("double")
    total, *got = members.withColumn("r", _rate(F.col("p"), x)).agg(F.sum(n), *[F.sum(n * F.col("r") * F.get("p", F.lit(d))) for d in range(len(DOMAINS))]).first()
    return [v / total for v in got] if total else None


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, p_high, p_low, p_toxic, rate of each row of docs."""
    members = memberships(docs, labels, id_col, text_col)
    x = fit_rates(members, targets or TARGETS)
    return members.select("doc_id", "n_tokens", *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], _rate(F.col("p"), x).alias("rate"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", tell: bool = False) -> DataFrame:
    """docs with its rates as a last column mix_rate; rows of rate 0 are gone. With tell, mix_residual follows: by how much the domain that misses its target most misses it (a share of all tokens; null without tokens). A rate is how often to take the document in an epoch. Texts are scored once: the table of docs with their posteriors serves the fit and the result."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    member = fresh(docs, "pw_member")
    scored = written(docs.withColumn(member, _member(fit(_sample(plain, labels)), F.col(text_col))), "scored")
    members, wanted = scored.select(f"`{member}`.n_tokens", f"`{member}`.p"), targets or TARGETS
    x = fit_rates(members, wanted)
    rate, residual = fresh(docs, "mix_rate"), fresh(docs, "mix_residual")
    rated = scored.withColumn(rate, _rate(F.col(f"`{member}`.p"), x)).where(F.col(rate) > 0).select(*docs.columns, rate)
    if not tell:
        return rated
    got, total = shares(members, x), max(1e-12, sum(wanted.get(d, 0.0) for d in DOMAINS))
    missed = max(abs(v - wanted.get(d, 0.0) / total) for d, v in zip(DOMAINS, got, strict=True)) if got else None
    return rated.withColumn(residual, F.lit(missed).cast("double"))
