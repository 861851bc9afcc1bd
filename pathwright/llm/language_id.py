"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample of the labelled rows
(PER_LANGUAGE rows of each of the LANGUAGES most frequent languages, none of more than TRAIN_CHARS characters), then calibrated with a temperature that
minimises the loss on a part of the sample kept aside. Every text is scored whole, in blocks of BLOCK characters.

Defined results: `und` and score 0 for a null text, one without any letter, or if nothing could be learned; ties go to
the language that sorts first. Rows with a null lang are predicted, not learned from; a null doc_id counts as ''."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_scan, fresh, id_bucket

PER_LANGUAGE = 700
LANGUAGES = 200
TRAIN_CHARS = 200_000
BITS = 16
ORDERS = (1, 2, 3)
BLOCK = 1 << 20
#: Characters up to which a text's buckets are sorted and not counted in an array of all buckets.
SHORT = 20_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.0005
CALIBRATION_SHARE = 5
#: The pipeline rejects documents whose calibrated probability is below this, besides `und`.
LEAST_SCORE = 0.4

_LETTER = regex.compile(r"\p{L}")


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that the text's n-grams fall into, and how many do."""
    counts = None
    reach = max(ORDERS) - 1
    for at in range(0, len(text), BLOCK):
        c = np.frombuffer(text[max(0, at - reach) : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        skip = min(at, reach)
        found = []
        for n in ORDERS:
            h = np.full(max(0, len(c) - n + 1), n, np.uint32)
            for j in range(n):
                h *= np.uint32(0x01000193)
                h ^= c[j : len(c) - n + 1 + j]
            h *= np.uint32(0x9E3779B1)
            found.append((h[max(0, skip - n + 1) :] >> np.uint32(32 - BITS)).astype(np.uint16))
        buckets = np.concatenate(found)
        if counts is None and len(text) <= SHORT:
            buckets.sort(kind="stable")  # by radix
            first = np.flatnonzero(np.diff(buckets, prepend=~buckets[:1]))
            return buckets[first].astype(np.int64), np.diff(first, append=len(buckets))
        more = np.bincount(buckets, minlength=1 << BITS)
        counts = more if counts is None else counts + more
    at = np.zeros(0, np.int64) if counts is None else np.flatnonzero(counts)
    return at, np.zeros(0, np.int64) if counts is None else counts[at]


class LanguageModel:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.bias, self.temperature = languages, idf, weights, bias, temperature

    def logits(self, text: str) -> np.ndarray:
        at, n = ngram_counts(text)
        x = np.log1p(n) * self.idf[at]
        return (x / max(1e-12, math.sqrt(float(x @ x)))) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(min(1.0, p[k]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: list[str]) -> LanguageModel:
    languages = sorted(set(labels))
    k = len(languages)
    width = 1 << BITS
    if not k:
        return LanguageModel([], np.zeros(width, np.float32), np.zeros((width, 0), np.float32), np.zeros(0), 1.0)
    where = {x: i for i, x in enumerate(languages)}
    rows = [ngram_counts(t) for t in texts]
    df = np.zeros(width)
    for at, _ in rows:
        df[at] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    data = []
    for (at, n), y in zip(rows, labels, strict=True):
        x = np.log1p(n) * idf[at]
        data.append((at, x / max(1e-12, math.sqrt(float(x @ x))), where[y]))
    order = np.random.default_rng(3).permutation(len(data))
    aside = set(order[::CALIBRATION_SHARE].tolist()) if len(data) >= 10 * k else set()
    z, n2 = np.zeros((width + 1, k)), np.zeros((width + 1, k))  # the last row is the bias

    def weight(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in order:
            if i in aside:
                continue
            at, x, y = data[i]
            at, x = np.append(at, width), np.append(x, 0.1)
            zs, ns = z[at], n2[at]
            w = weight(zs, ns)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            new = ns + g * g
            z[at] = zs + g - (np.sqrt(new) - np.sqrt(ns)) / ALPHA * w
            n2[at] = new
    w = weight(z, n2)
    model = LanguageModel(languages, idf.astype(np.float32), w[:-1].astype(np.float32), 0.1 * w[-1], 1.0)
    if aside:
        logits = np.stack([data[i][1] @ w[data[i][0]] + model.bias for i in sorted(aside)])
        truth = np.array([data[i][2] for i in sorted(aside)])
        grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
        loss = [-np.log(np.maximum(1e-12, softmax(logits / t)[np.arange(len(truth)), truth])).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns from rows whose crc32 modulo 4 is not 2. A row is in the sample if its id's hash is below its language's threshold."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where((id_bucket("doc_id", 4) != 2) & F.col("lang").isNotNull() & (F.length("text") > 0) & (F.length("text") <= TRAIN_CHARS))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return fit([], [])
    span = 1 << 30
    limit = F.try_element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(span, math.ceil(span * PER_LANGUAGE / n)))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", F.xxhash64("text")), F.lit(span))
    picked = rows.select("text", "lang", draw.alias("draw")).where(F.col("draw") < limit)
    got = picked.orderBy("draw", F.xxhash64("text")).limit(2 * PER_LANGUAGE * len(counts)).collect()
    return fit([r["text"] for r in got], [r["lang"] for r in got])


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """docs with the predicted language and its score appended, and the names of those two columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = fresh(docs, "pw_lang_pred"), fresh(docs, "pw_lang_score")

    def factory():
        predict = shared.value.predict

        def scan(texts: list) -> list[pa.Array]:
            got = [predict(t) for t in texts]
            return [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]

        return scan

    return append_scan(docs, text_col, [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())], factory), *names


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs, learned from docs itself."""
    model = train(docs, id_col, text_col, lang_col)
    df, lang, score = with_language(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), model)
    return df.select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs in a language that the model knows and is fairly sure of."""
    df, lang, score = with_language(docs, train(docs))
    return df.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)
