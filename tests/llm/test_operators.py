"""The training-data operators against brute force, on the tables and on small hard cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pathwright.llm import common, decontamination, language_id, licenses, main_text, mixing, ngram_model, personal_data, queries, simhash, token_counts, topk

SF = "/root/testdata/sf0.001"
HARD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (5, "x" * 300_000 + " y"), (6, "one two three " * 20_000), (7, "Ünïcode 😀 Word"), (8, "one two"), (None, "one two")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(*r, "clash") for r in HARD], "doc_id long, text string, n_tokens string")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def same(rows, want):
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_top_k(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = e.collect()
    v = np.floor(256 * np.array([r.embedding for r in rows], float)).astype(int)
    ids = [r.vec_id for r in rows]
    want = []
    for i, q in enumerate(ids):
        if q % 50 == 0:
            best = sorted((-int(s), c) for s, c in zip(v @ v[i], ids, strict=True) if c != q)[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    same(topk.exact_top_k(e, e.where("vec_id % 50 = 0")).collect(), want)


def test_top_k_hard(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0]), (5, [1e20, 1e20]), (6, [1e20, -1e20]), *[(i, [0.5, 0.5]) for i in range(10, 30)], (None, [9.0, 9.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.exact_top_k(e, e.where("vec_id = 0")).collect()
    big = 256 * math.floor(256 * 1e20)
    top = min(big, (1 << 63) - 1)
    same(got, [(0, 1, 5, top), (0, 2, 6, top), (0, 3, 10, 256 * 128), (0, 4, 11, 256 * 128), (0, 5, 12, 256 * 128)])
    assert topk.exact_top_k(e.where("false"), e.where("false")).collect() == []


def test_ngram_model(spark, docs, hard):
    for df in (docs, hard):
        rows = df.collect()
        tok = [re.findall(r"[^\x20\x09-\x0D]+", lower(r.text)) + ["\n"] for r in rows]
        held = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2 for r in rows]
        train = [t for t, h in zip(tok, held, strict=True) if not h]
        c = Counter(w for t in train for w in t)
        n, v = sum(c.values()), len(c)
        bi, ctx = Counter(), Counter()
        for t in train:
            for a, b in zip([None, *t], t, strict=False):
                bi[a, b] += 1
                ctx[a] += 1
        follow, cont = defaultdict(lambda: [0, 0, 0]), Counter()
        for (a, b), k in bi.items():
            follow[a][min(k, 3) - 1] += 1
            cont[b] += 1
        d, u = (ngram_model.discounts(*[sum(x == j for x in z.values()) for j in (1, 2, 3, 4)]) for z in (bi, cont))
        off = lambda k, d: 0 if k == 0 else d[min(k, 3) - 1]
        total, spread = sum(cont.values()), sum(off(k, u) for k in cont.values())
        low = lambda w: (cont[w] - off(cont[w], u) + spread / (v + 1)) / total

        def p(a, w):
            return (bi[a, w] - off(bi[a, w], d) + sum(x * y for x, y in zip(follow[a], d, strict=True)) * low(w)) / ctx[a] if ctx[a] else low(w)

        assert sum(p("the", w) for w in c) + p("the", "not seen") == pytest.approx(1)
        got = sorted(ngram_model.score_texts(df).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
        order = sorted(range(len(rows)), key=lambda i: (str(rows[i].doc_id), len(tok[i])))
        for r, i in zip(got, order, strict=True):
            t = tok[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
            assert r.score == pytest.approx(sum(math.log10(p(a, w)) for a, w in zip([None, *t], t, strict=False)))
    assert ngram_model.score_texts(docs.where("false")).collect() == []


def test_ngram_model_of_order_3(spark, docs, hard):
    for df in (docs, hard):
        rows = df.collect()
        tok = [["<s>", *re.findall(r"[^\x20\x09-\x0D]+", lower(r.text)), "\n"] for r in rows]
        train = [t for t, r in zip(tok, rows, strict=True) if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2]
        grams = {k: Counter(tuple(t[i : i + k]) for t in train for i in range(len(t) - k + 1)) for k in (2, 3)}
        # below the highest order an n-gram counts the words before it; where it begins a text, its occurrences
        count = {3: grams[3], 2: Counter(g[1:] for g in grams[3]), 1: Counter(g[1:] for g in grams[2])}
        count[2] |= {g: k for g, k in grams[2].items() if g[0] == "<s>"}
        v = len(count[1])
        d = {k: ngram_model.discounts(*[sum(x == j for x in count[k].values()) for j in (1, 2, 3, 4)]) for k in count}
        off = lambda k, n: 0 if n == 0 else d[k][min(n, 3) - 1]
        total, freed = Counter(), Counter()
        for k in count:
            for g, n in count[k].items():
                total[k, g[:-1]] += n
                freed[k, g[:-1]] += off(k, n)

        def p(g):
            lower_p = p(g[1:]) if len(g) > 1 else 1 / (v + 1)
            t = total[len(g), g[:-1]]
            n = count[len(g)][g]
            return (n - off(len(g), n) + freed[len(g), g[:-1]] * lower_p) / t if t else lower_p

        assert {k: sum(n == 0 for n in count[k].values()) for k in count} == {1: 0, 2: 0, 3: 0}
        for g in list(grams[2])[:3]:
            assert sum(p((*g, *w)) for w in count[1]) + p((*g, "not seen")) == pytest.approx(1)
        want = sorted((str(r.doc_id), sum(math.log10(p(tuple(t[max(0, i - 2) : i + 1]))) for i in range(1, len(t)))) for r, t in zip(rows, tok, strict=True))
        got = sorted((str(r.doc_id), r.score) for r in ngram_model.score_texts(df, order=3).collect())
        assert [x[0] for x in got] == [x[0] for x in want] and [x[1] for x in got] == pytest.approx([x[1] for x in want])
    assert ngram_model.score_texts(docs.where("false"), order=3).collect() == []
    nothing = ngram_model.train(docs.where("false"), order=3).score(["two words", None])
    assert nothing["score"].tolist() == [0, 0] and nothing["n_tokens"].tolist() == [3, 1]
    with pytest.raises(ValueError, match="order"):
        ngram_model.train(docs, order=4)


def luhn(s):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def test_personal_data(spark, docs):
    rng = np.random.default_rng(5)
    parts = ["a", "b", "1", "12", "255", ".", ".", "@", "+", "-", " ", "(", ")", "_", "é", "😀", "4111 1111 1111 1111", "a@b.c", "1.2.3.4", "+1 (988) 555-2485", "\n", "378282246310005"]
    made = spark.createDataFrame([(i, "".join(rng.choice(parts, rng.integers(0, 40)))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "x " * 100_000 + "a@b.co " * 500)], "doc_id long, text string")
    for df in (docs, made):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        for r in personal_data.find(df).collect():
            spans = base_spans(texts[r.doc_id])
            listed = ",".join(f"{k}:{a}:{z}" for a, _, z, k in spans)
            assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), texts[r.doc_id]
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in spans) for k in ("email", "ip", "card", "phone")]
            assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_redaction(spark):
    df = spark.createDataFrame([(1, "Mail a.b@c.de, IBAN DE89 3704 0044 0532 0130 00 or DE88 3704 0044 0532 0130 00, card 4111 1111 1111 1111, not 4111 1111 1111 1112"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.text for r in personal_data.redacted(df).orderBy("doc_id").collect()] == ["Mail [EMAIL], IBAN [IBAN] or DE88 3704 0044 0532 0130 00, card [CARD], not 4111 1111 1111 1112", None, ""]


def test_main_text():
    w = main_text.fit([])
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a>a</a></nav><div class="cookie-notice">We use cookies. Accept them.</div>
    <article><h1>Real &amp; title</h1><p>First <b>para</b>graph<br>goes on.<p>Second one, with <a href=y>a link</a>.<aside>Side.</aside><div class=ad>Buy now!</div></article>
    <div class="comments"><p>Great article, I like it. Really.</p></div><form><p>Sign up</p></form><footer>&copy; firm</footer><script>"<p>no</p>"</script></body></html>"""
    assert main_text.main_text(page, w) == "Real & title First paragraph goes on. Second one, with a link."
    assert [main_text.main_text(x, w) for x in (None, "", "<p></p>", "<script>x", "<!-- x", "<p>Well, this is text. It goes on.</p><a href='")] == ["", "", "", "", "", "Well, this is text. It goes on."]


def test_cut_is_minimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        a, b = rng.random(n).tolist(), rng.random(n).tolist()
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda side: sum(y if s else x for x, y, s in zip(a, b, side, strict=True)) + sum(w for i, j, w in edges if side[i] != side[j])  # noqa: B023, E731
        least = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(main_text.cut(a, b, edges)) == pytest.approx(least)


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs, spark.read.parquet(f"{SF}/labels.parquet"), {"high": 0.7, "low": 0.2, "toxic": 0.1}).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    assert all(abs(r.p_high + r.p_low + r.p_toxic - 1) < 1e-9 for r in rows)
    total = sum(r.n_tokens for r in rows)
    for d, share in (("high", 0.7), ("low", 0.2), ("toxic", 0.1)):
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) / total == pytest.approx(share, abs=0.02)


def test_mixing_hard(spark, hard):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len(mixing.mix(hard, none).collect()) == len(HARD)
    assert mixing.mix(hard.where("false"), none).collect() == []
    some = spark.createDataFrame([(4, 1, None), (None, 1, 1), (8, None, 1), (8, 0, 0), (99, None, None)], "doc_id long, quality int, toxic int")
    kept = mixing.mixed(hard, some)
    assert kept.columns == [*hard.columns, "mix_rate"] and all(r.mix_rate > 0 for r in kept.collect())


def test_decontamination(spark, docs, hard):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").unionByName(spark.createDataFrame([(900, "one two three"), (901, None), (902, "..."), (None, "ünïcode"), (900, "one two three")], "item_id long, text string"))
    found = decontamination.windows([(None if r.item_id is None else str(r.item_id), r.text) for r in bench.collect()])
    for df in (docs, hard):
        want = []
        for r in df.collect():
            w = decontamination.words_of(r.text)
            assert [x.decode() for x in w] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))
            hit, items = bytearray(len(w)), set()
            for m in {len(p) for p in found}:
                for i in range(len(w) - m + 1):
                    owners = found.get(tuple(w[i : i + m]))
                    if owners:
                        hit[i : i + m] = b"\1" * m
                        items |= owners - {None}
            want.append((r.doc_id, len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), any(hit)))
        same(decontamination.decontaminate(df, bench).collect(), want)


def test_decontamination_in_passes(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = decontamination.decontaminate(docs, bench).collect()
    monkeypatch.setattr(decontamination, "PASS_WORDS", 800)
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 30)
    df, _ = decontamination.scan_windows(docs, bench)
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 4  # no chain of passes
    same(decontamination.decontaminate(docs, bench).collect(), map(tuple, want))


def test_simhash(spark, docs, hard):
    for df in (docs, hard):
        rows = df.collect()
        prints = []
        for r in rows:
            w = re.findall(r"[^\x20\x09-\x0D]+", lower(r.text))
            s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
            h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
            prints.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)))
        node = [r.doc_id if r.doc_id is not None else f"row{i}" for i, r in enumerate(rows)]
        reach = {x: {x} for x in node}
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 2 and reach[node[i]] is not reach[node[j]]:
                    both = reach[node[i]] | reach[node[j]]
                    for x in both:
                        reach[x] = both
        ids = [min((x for x in reach[n] if not isinstance(x, str)), default=None) for n in node]
        same(simhash.near_duplicates(df).collect(), [(r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, ids, strict=True)])


def test_simhash_finds_every_link_in_dense_groups(spark):
    rng = np.random.default_rng(9)
    points = np.unique(np.concatenate([rng.integers(0, 1 << 64, 300, dtype=np.uint64), *[np.uint64(rng.integers(0, 1 << 64, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (200, 3), dtype=np.uint64)).sum(axis=1) for _ in range(3)]]))
    df = spark.createDataFrame([(int(p.view(np.int64)), i) for i, p in enumerate(points)], "fp long, node long")
    tree, n = simhash.number_leaves(simhash.plan_shards(points, 16))
    assert n > 1
    got = {r.v: r.p for r in simhash.components(simhash._edges(df, tree)).collect()}
    label = simhash.local_forest(points, np.ones(len(points), bool))
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    want = np.arange(len(points))
    while True:
        new = np.where(near, want[None, :], len(points)).min(axis=1)
        if np.array_equal(new, want):
            break
        want = new
    assert label.tolist() == want.tolist() == [got.get(i, i) for i in range(len(points))]


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in language_id.identify(docs).collect() if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in held)
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.97


def test_language_hard(spark, hard):
    got = language_id.identify(hard.withColumn("lang", F.when(F.col("doc_id") == 4, "zz"))).collect()
    assert len(got) == len(HARD)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)} == {("und", 0.0)}
    assert {r.lang_pred for r in language_id.identify(hard.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_licenses(spark):
    lines = [(1, "text here\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "Released under the MIT License."), (3, "nothing"), (4, None), (5, "The license plate was dirty."), (6, "All rights reserved.\nLicensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert [got[i].families for i in range(1, 7)] == ["apache-2.0", "mit", "", "", "", "all-rights-reserved,cc-by-nc"]
    assert got[1].notices == "1:apache-2.0" and got[1].confirmed and not got[3].confirmed


def test_token_counts(spark, docs, hard):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for df in (docs, hard):
        want = [(r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in df.collect()]
        same(token_counts.count_tokens(df, path).collect(), want)
    v = token_counts.Vocabulary(open(path, "rb").read())
    rng = np.random.default_rng(4)
    letters = [chr(c) for c in [*range(0x250), 0x1680, 0x200B, 0x2028, 0x3000, 0x85, 0xA0, 0x1C, 0x660, 0x4E00, 0x1F600]] + ["  ", "'s", "<|endoftext|>", "the "]
    for _ in range(500):
        s = "".join(rng.choice(letters, rng.integers(0, 30)))
        assert v.count(s) == len(library.encode(s, add_special_tokens=False).ids), s


def test_every_query_runs_on_the_tables(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    for name in ("op4_main_text", "op9_licenses"):
        assert queries.queries()[name](spark, SF).count() > 0


def test_pipeline(spark):
    corpus = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = docs
    for name, stage in corpus.STAGES:
        after = stage(spark, last, SF)
        assert after.columns[: len(docs.columns)] == docs.columns and (after.columns == docs.columns or name == "mixture")
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        assert set(ids) <= {r.doc_id for r in last.select("doc_id").collect()} and len(ids) == len(set(ids))
        last = common.written(after, "test")
    assert 0.5 * docs.count() < last.count() < docs.count()
