"""Source divergence, collocations and repeated lines against SQL and brute force, and on hostile rows."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pathwright.llm import collocations as C
from pathwright.llm import divergence as D
from pathwright.llm import line_dedup as L
from pathwright.llm import queries

SF = "/root/testdata/sf0.001"
NAMES = ["op11_source_divergence", "op12_collocations", "op13_line_dedup"]
CLASHES = "n_lines n_dropped keep doc t1 t2 h1 h2 pos kind term n df entries total v size m a b ca cb value rank phrase l r score word f ids part key check count slots task".split()
TEXTS = [(1, None), (2, ""), (3, " \n\t\n"), (4, "a b. a b"), (4, "a b. a b"), (5, "x" * 200_000 + " y"), (6, "one two three\n" * 20_000), (7, "Ünïcode 😀 Word\x00\x1f q"), (None, "one two three"), (None, None)]


@pytest.fixture(scope="module")
def hostile(spark):
    base = spark.createDataFrame([(i, t, None if i in (2, 5) else "en", None if i == 3 else "web", 7) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return base.withColumns({c: F.lit("clash") for c in CLASHES})


def by_sql(name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        con.register(t, rows)
    want = con.sql(queries.oracle_sql()[name])
    names = sorted(want.columns)
    return sorted(([r[want.columns.index(c)] for c in names] for r in want.fetchall()), key=str)


def rows_of(df):
    names = sorted(df.columns)
    return sorted(([r[c] for c in names] for r in df.collect()), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_queries_match_sql(spark, name):
    import pyarrow.parquet as pq

    assert rows_of(queries.queries()[name](spark, SF)) == by_sql(name, documents=pq.read_table(f"{SF}/documents.parquet"))


def made(n, seed):
    """Rows with a hot language, a hot source, words and lines, and nulls in each column."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["São", "naïve", "x\x01", "X"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!", "-"]) for _ in range(rng.choice([0, 1, 5, 40])))
        text += "\n" + rng.choice(["A line that nearly all documents hold", " a LINE that nearly all documents hold\t", f"line of some length, number {i % 30:03d}", ""])
        out.append((rng.choice([i, i, i, i // 2, None]), rng.choice([text, text, text, text, None]), rng.choice(["en", "en", "en", "de", None, "und", ""]), rng.choice(["big", "big", "s1", "s2", "s3", None]), 1))
    return out


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("aqe", ["true", "false"])
def test_made_rows_match_sql(spark, monkeypatch, name, aqe, tmp_path):
    import pyarrow as pa

    rows = made(400, 3)
    table = pa.table({c: list(v) for c, v in zip(("doc_id", "text", "lang", "source", "n_chars"), zip(*rows, strict=True), strict=True)})
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rows_of(queries.queries()[name](spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before[1])
    assert got and got == by_sql(name, documents=table)


def test_hostile_rows(hostile):
    lines = L.digests(hostile).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped) for r in lines) == sorted([("1", 1, 0), ("2", 1, 0), ("3", 3, 0), ("4", 1, 0), ("4", 1, 0), ("5", 1, 0), ("6", 20_001, 0), ("7", 1, 0), ("None", 1, 0), ("None", 1, 0)])
    assert {r.doc_id: r.kept_sha256 for r in lines}[5] == hashlib.sha256(("x" * 200_000 + " y").encode()).hexdigest()
    audit = D.audit(hostile, min_docs=1).collect()
    assert {(r.lang, r.source) for r in audit if r.part == "pair"} == {("en", "web"), ("en", "")}
    assert [(r.phrase, r.a) for r in C.collocations(hostile).collect()] == [("one two three", 20_001)]
    # the pieces end with their lines, so no phrase crosses from one line to the next
    assert C.collocations(hostile, least=20_002).collect() == []
    for run in (L.digests, L.keep_bitmaps, L.deduplicated, D.audit, C.collocations):
        assert run(hostile.where("false")).collect() == []
        assert len(run(hostile.withColumn("text", F.lit(None).cast("string"))).collect()) in (0, 2, len(TEXTS))  # two: the pair of sources


def test_other_column_names(spark):
    rows = [(i, "This line is found in every document.\nown line, number %d of all" % i, "en", f"s{i % 3}") for i in range(40)]
    docs = spark.createDataFrame(rows, "k long, body string, tongue string, site string")
    assert {r.k for r in L.keep_bitmaps(docs, "k", "body").collect()} == set(range(39))
    left = {r.k: r.body for r in L.deduplicated(docs, "k", "body").collect()}
    assert left[39].count("\n") == 1 and left[5] == "own line, number 5 of all"
    assert {(r.source, r.item) for r in D.audit(docs, "body", "tongue", "site").where("part = 'pair'").collect()} == {(a, b) for a in ("s0", "s1", "s2") for b in ("s0", "s1", "s2") if a != b}
    assert C.collocations(docs, "body", "tongue").where("phrase = 'this line is'").count() == 1


def test_lines_cut_at_any_place():
    """The stream gives the same whatever tasks and batches its rows are cut into."""
    rng = random.Random(8)
    for _ in range(300):
        rows = sorted({(rng.choice([1, 1, 1, 2, 3, 4]), 0, -rng.randrange(6), rng.randrange(3)) for _ in range(rng.randrange(1, 40))})
        rows = [(h, z, -d, p) for h, z, d, p in rows]
        docs = defaultdict(set)
        for h, _, d, _ in rows:
            docs[h].add(d)
        want = sorted((h, d, p) for h, _, d, p in rows if len(docs[h]) >= 3 and d < max(docs[h]))
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(5)))})
        found = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            stream, at = L._Stream(), lo
            while at < hi:
                step = min(hi, at + rng.randrange(1, 9))
                c = [np.array([r[k] for r in rows[at:step]], np.int64) for k in (0, 1, 2)] + [np.zeros(step - at, np.int64)] * 2 + [np.array([r[3] for r in rows[at:step]], np.int32)]
                found += [r for b in stream.read(c) for r in zip(*b.to_pydict().values(), strict=True)]
                at = step
            found += [r for b in stream.close(True) for r in zip(*b.to_pydict().values(), strict=True)]
        edges = defaultdict(set)
        for r in found:
            if r[0] == L._EDGE:
                edges[r[1]].add(r[3])
        got = [(r[1], r[3], r[6]) for r in found if r[0] == L._DROP or (r[0] == L._OPEN and len(edges[r[1]]) >= 3 and r[3] < max(edges[r[1]]))]
        assert sorted(got) == want
        assert sum(r[0] == L._EDGE for r in found) <= 6 * (len(cuts) - 1)


def test_bitmaps():
    for n in (1, 7, 8, 9, 1000):
        gone = sorted(random.Random(n).sample(range(n), max(1, n // 3)))
        batch = next(L._bitmaps(iter([__import__("pyarrow").RecordBatch.from_pydict({"doc": [1], "t1": [1], "t2": [1], "gone": [gone]})])))
        assert np.flatnonzero(~L.stays(batch.column(4)[0].as_py(), n + 5)).tolist() == gone


def test_minimal_perfect_hash(spark, tmp_path):
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    sizes, bits, ranks, order = C.levels(keys)
    assert sorted(order.tolist()) == list(range(len(keys))) and sum(sizes) == len(bits) == len(ranks)
    df = spark.createDataFrame([(int(k), 0, int(i)) for i, k in enumerate(keys)], "key long, check long, count long")
    hash_ = C.build(df, "hash", len(keys), 3_000)
    slots = hash_.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))  # minimal and perfect
    assert (hash_.read("keys", slots) == keys).all() and (hash_.read("counts", slots) == np.arange(len(keys))).all()
    others = np.setdiff1d(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64), keys)
    assert (hash_.slots(others) == -1).all()
    assert C.levels(np.zeros(0, np.uint64))[0] == []


def test_many_parts_and_small_arrays(spark, monkeypatch):
    """Small limits: parts of few keys, tasks that send their arrays on early, several levels of the tree."""
    rows = made(300, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    want = rows_of(C.collocations(docs))
    monkeypatch.setattr(C, "SLOTS", 50)
    monkeypatch.setattr(C, "HELD", 400)
    monkeypatch.setattr(C, "FAN", 2)
    assert want and rows_of(C.collocations(docs, part_keys=20)) == want


def test_exact_scores(spark):
    big = 3_000_000_000_000
    df = spark.createDataFrame([(big, big + 1, big + 7), (7, 9, 11)], "a long, l long, r long")
    assert [r[0] for r in df.select(C._score(F.col("a"), F.col("l"), F.col("r"))).collect()] == [1_000_000 * big * big // ((big + 1) * (big + 7)), 1_000_000 * 49 // 99]
    p = [r[0] for r in df.select(D._share(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert p == [1 + 10**9 * (big + 2) // (big + 1 + 2 * (big + 7)), 1 + 10**9 * 9 // 31]


def test_tally_in_small_steps(spark, monkeypatch):
    """Joint cells are the same however often a task sends them on."""
    rng = random.Random(2)
    rows = [("en" if k % 3 else "de", sorted((f"s{j}", rng.randrange(1, 4)) for j in rng.sample(range(9), rng.randrange(1, 9)))) for k in range(400)]
    want = Counter()
    for lang, entries in rows:
        for i, (a, x) in enumerate(entries):
            for b, y in entries[i + 1 :]:
                want[lang, a, b, x, y] += 1
    monkeypatch.setattr(D, "TALLIED", 60)
    monkeypatch.setattr(D, "HELD", 5)
    df = spark.createDataFrame(rows, "lang string, entries array<struct<source: string, n: long>>").repartition(3)
    got = Counter()
    for r in df.mapInArrow(D._tally, D._TALLY).collect():
        got[r.lang, r.a, r.b, r.ca, r.cb] += r.m
    assert got == want
