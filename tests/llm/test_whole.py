"""Operators do the whole of their job: cases in which they once did less."""

import math
import re
import time
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathwright.llm import decontamination, language_id, licenses, main_text, mixing, ngram_model, personal_data, simhash, topk


@pytest.mark.parametrize("spread", [3.0, 1.0])
def test_mixing_reaches_the_production_targets(spark, spread):
    z = np.random.default_rng(0).normal(size=(5000, 3)) * spread + [0, 0.5, -0.5]
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    members = spark.createDataFrame([(i, 1 + i % 97, row) for i, row in enumerate(p.tolist())], "doc_id long, n_tokens long, p array<double>")
    x = mixing.fit_rates(members, mixing.TARGETS)
    rows = members.select("n_tokens", "p", mixing._rate(members["p"], x).alias("rate")).collect()
    got = sum(r.rate * r.n_tokens * np.array(r.p) for r in rows) / sum(r.n_tokens for r in rows)
    assert got == pytest.approx([mixing.TARGETS[d] for d in mixing.DOMAINS], abs=1e-6)


def test_mixing_of_the_documents_reaches_the_production_targets(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.mix(docs, labels).collect()
    total = sum(r.n_tokens for r in rows)
    for d, share in mixing.TARGETS.items():
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) / total == pytest.approx(share, abs=1e-6)


def test_mixing_tells_of_targets_out_of_reach(spark):
    members = spark.createDataFrame([(1, 10, [0.9, 0.05, 0.05]), (2, 10, [0.2, 0.75, 0.05])], "doc_id long, n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="do not reach the targets"):
        mixing.fit_rates(members, mixing.TARGETS)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        mixing.fit_rates(members, {"high": 0.7, "low": 0.25, "toxic": 0.05})


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell."""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""


def test_licenses_without_anchors_and_over_lines(spark):
    texts = ["Distributed under GPLv3.", "Released under LGPL 2.1 or later.", "CC-BY-SA 4.0", "Released under Apache-2.0", MIT, GPL, f"{GPL}\n\nprose of the day\n \n{MIT}", "Code: MIT License\n\nText: CC-BY-SA 4.0"]
    want = ["0:gpl-3.0", "0:lgpl", "0:cc-by-sa", "0:apache-2.0", "0:mit", "0:gpl-3.0", "0:gpl-3.0,7:mit", "0:mit,2:cc-by-sa"]
    texts += ["The first of them was there with all the others, and it is of no use.", "under the work of the page", "Ein Haus mit Garten und Licht"]
    want += [""] * 3
    got = {r.doc_id: r.notices for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_licenses_gate_loses_nothing():
    families, weights, bias = licenses.fit()
    none = families.index(licenses.NONE)
    keys, gate = set(licenses.keys()), re.compile(licenses._gate())
    assert max(bias) == bias[none]
    for gram in weights:
        assert keys & set(gram.split()) and gate.search(f"({gram})"), gram


SAID = "Words of an article go on here, and on. " * 8
PARTS = f"<nav><a href=x>Home</a> <a href=y>News</a></nav><h1>A title of some words</h1><p>{SAID}</p><p>{SAID}</p><footer>The firm</footer>"
BODY = f"A title of some words {SAID}{SAID}".strip()


@pytest.mark.parametrize("before, after", [("<form id=aspnetForm>", "</form>"), ("<div class='page-sidebar-left'>", "</div>"), ("<div class='layout menu-open'>", "</div>"), ("<form><div class='layout menu-open'>", "</div></form>"), ("<form><main>", "</main></form>"), ("<form><article>", "</article></form>")])
def test_wrappers_keep_the_main_text(before, after):
    w = main_text.fit([])
    assert main_text.main_text(before + PARTS + after, w) == main_text.main_text(PARTS, w) == BODY


def test_comments_larger_than_the_article_are_left_out():
    page = f"<article><h1>A title of some words</h1><p>{SAID}</p></article><div class=comments>" + f"<article><p>{SAID}</p></article>" * 5 + "</div>"
    assert main_text.main_text(page, main_text.fit([])) == f"A title of some words {SAID}".strip()


def test_quoted_attributes_of_any_length():
    w = main_text.fit([])
    assert main_text.main_text(f"""<div data-x='{{"html": "<p>no</p>{"x" * 10_000}>"}}'>{PARTS}</div>""", w) == BODY
    assert main_text.main_text(f"""<div data-x="<p>it's{">" * 10_000}">{PARTS}</div>""", w) == BODY
    assert main_text.main_text(f"""<div class="a""><p title='it's'>{SAID}</p></div>""", w) == SAID.strip()
    start = time.time()
    main_text.blocks_of("<a x='>" * 100_001 + '<b y="' * 100_001)
    main_text.blocks_of("<a x='\">" * 50_000 + "<b y=\"z'>" * 50_001)
    assert time.time() - start < 30


def thue_morse(k, flip):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(1 << k))


def test_words_of_the_corpus_that_other_hashes_confuse():
    words = [thue_morse(k, f) for k in range(1, 13) for f in (0, 1)] + [a + b for a in "abcdefgh" for b in "abcdefgh"] + ["x" * n for n in range(1, 3000)]
    words = sorted(set(words))
    h, ends = ngram_model.token_hashes([" ".join(words), "ab\tAB  ab\n", "", None])
    assert len(set(h[: ends[0]].tolist())) == len(words) + 1 and len(set(h[ends[0] : ends[1] - 1].tolist())) == 1 and ends.tolist() == [len(words) + 1, len(words) + 5, len(words) + 6, len(words) + 7]


@pytest.mark.parametrize("order", [2, 3])
def test_ngram_model_in_many_shards(spark, monkeypatch, order):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: r for r in ngram_model.score_texts(docs, order=order).collect()}
    for name, value in (("SHARD_TEXT", 8 << 10), ("FILE_BITS", 3), ("FAN", 4), ("PART", 1 << 9), ("OPEN", 5)):
        monkeypatch.setattr(ngram_model, name, value)
    model = ngram_model.train(docs, order=order)
    assert len(model.words.sizes) == 8 and model.types > 3 * model.part
    got = ngram_model.score_texts(docs, order=order).collect()
    assert len(got) == len(want)
    for r in got:
        assert r[:5] == want[r.doc_id][:5] and r[5:] == pytest.approx(want[r.doc_id][5:])
    texts = [r.text for r in docs.limit(50).collect()]
    model.score(texts)
    assert len(ngram_model._MAPS) <= 5


def test_top_k_of_repeated_rows_and_many_blocks(spark, monkeypatch):
    rows = [(0, [1.0, 0.5])] * 9 + [(3, [1.0, 0.5])] * 7 + [(i, [1.0, 0.5]) for i in (5, 7, 9, 50)] + [(100 + i, [0.01 * i, 0.3]) for i in range(200)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def brute(q, v):
        own = np.floor(256 * np.array(v))
        best = sorted((-int(own @ np.floor(256 * np.array(x))), i) for i, x in rows if i != q)[:5]
        return [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]

    want = sorted(x for q, v in dict(rows).items() if q % 50 == 0 or q == 3 for x in brute(q, v))
    for size, seeds in ((24 << 20, 2048), (64, 3), (64, 40)):
        monkeypatch.setattr(topk, "QUERY_BYTES", size)
        monkeypatch.setattr(topk, "SEEDS", seeds)
        got = topk.exact_top_k(e.repartition(3), e.where("vec_id % 50 = 0 or vec_id = 3")).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_window_search_against_all_places():
    rng = np.random.default_rng(3)
    for trial in range(60):
        letters = [b"a", b"b", b"c", b"d", b"e"][: 2 + trial % 4]
        items = [(f"i{k}", rng.choice(letters, rng.integers(1, 25)).tolist()) for k in range(rng.integers(0, 8))]
        size = int(rng.integers(1, 8))
        wm = decontamination.WuManber(items, size)
        words = rng.choice([*letters, b"z"], 300).tolist() + [w for _, x in items for w in x]
        got = {(s, e, wm.owner[k]) for s, e, ks in wm.search(list(wm.numbers(words))) for k in ks}
        want = set()
        for item, x in items:
            m = min(size, len(x))
            for at in range(len(x) - m + 1):
                want |= {(s, s + m, item) for s in range(len(words) - m + 1) if words[s : s + m] == x[at : at + m]}
        assert got == want


def test_tables_of_a_pass_are_small():
    import pickle

    rng = np.random.default_rng(4)
    words = [b"w%d" % k for k in range(20_000)]
    items = [(str(k), [words[i] for i in rng.integers(0, len(words), 100)]) for k in range(2_000)]
    assert len(pickle.dumps(decontamination.WuManber(items))) < 100 * 200_000  # under 100 bytes a word: 100 MB a pass


def test_simhash_splits_large_shards(spark, monkeypatch):
    rng = np.random.default_rng(12)
    loose = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    ball = np.uint64(rng.integers(0, 1 << 64, dtype=np.uint64)) ^ np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (2500, 12), dtype=np.uint64), axis=1)
    points = np.unique(np.concatenate([loose, loose[:300] ^ np.uint64(5), ball]))
    df = spark.createDataFrame([(int(p.view(np.int64)), i) for i, p in enumerate(points)], "fp long, node long").repartition(4)
    monkeypatch.setattr(simhash, "PLAN_SAMPLE", 64)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 700)
    monkeypatch.setattr(simhash, "VISITORS", 400)
    tree = simhash.shard_tree(df)
    rows = simhash._blocks(df, tree)
    sizes = {(r.shard, r.block): r for r in rows.groupBy("shard", "block").agg(F.count_if("home").alias("own"), F.count_if(~F.col("home")).alias("visit")).collect()}
    shards = {s for s, _ in sizes}
    assert len(shards) > 8 and len(sizes) > len(shards) and max(r.own for r in sizes.values()) <= 700 and max(r.visit for r in sizes.values()) <= 600
    assert rows.where("home and block = 0").count() == len(points)
    got = {r.v: r.p for r in simhash.components(simhash._edges(df, tree)).collect()}
    assert [got.get(i, i) for i in range(len(points))] == simhash.local_forest(points, np.ones(len(points), bool)).tolist()


def test_simhash_copies_of_random_fingerprints_are_few(spark, monkeypatch):
    """Rows shuffled a fingerprint and entries of the tree that goes to all workers, for many fingerprints without structure; planted links are found."""
    rng = np.random.default_rng(3)
    points = rng.integers(0, 1 << 64, 150_000, dtype=np.uint64)
    planted = points[:1500] ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64))
    points = np.unique(np.concatenate([points, planted]))
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"fp": points.view(np.int64), "node": np.arange(len(points))})).repartition(8)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 5_000)
    monkeypatch.setattr(simhash, "VISITORS", 20_000)
    tree = simhash.shard_tree(df)
    leaves = simhash.number_leaves(tree)[1]
    rows = simhash._blocks(df, tree).count() / len(points)
    assert leaves <= 8 * len(points) / 5_000 and rows < 16
    got = {r.v: r.p for r in simhash.components(simhash._edges(df, tree)).collect()}
    place = {int(x): i for i, x in enumerate(points)}
    top = lambda i: got.get(i, i)
    known = {int(a) for a in points}
    pairs = [(place[int(a)], place[int(b)]) for a, b in zip(points_of(planted, rng, known), planted, strict=True) if int(a) in place]
    assert len(got) >= 1400 and all(top(a) == top(b) for a, b in pairs)


def points_of(planted, rng, known):
    """For each planted fingerprint one of the known ones within two bits."""
    for p in planted:
        yield next((q for i in range(64) for j in range(i, 64) if i != j and (q := int(p) ^ 1 << i ^ 1 << j) in known), int(p))


def test_simhash_links_through_rows_without_an_id_and_through_one_id(spark):
    texts = ["a b c d e f g", "h i j k l m n", "o p q r s t u", "only here", "and here"]
    rows = [(5, texts[0]), (5, texts[1]), (9, texts[1]), (3, texts[2]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (None, texts[4]), (7, texts[0]), (None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (9, 5), (3, 3), (None, 3), (None, None), (None, None), (None, None), (7, 5), (None, None)], key=str)
    left = simhash.one_of_each(df)
    assert left.columns == df.columns and sorted(((r.doc_id, r.text) for r in left.collect() if r.doc_id != 5), key=str) == sorted([(3, texts[2]), (None, texts[3]), (None, texts[4]), (None, None)], key=str)
    assert [r.doc_id for r in left.collect()].count(5) == 1 and left.collect() and sorted(map(str, left.collect())) == sorted(map(str, simhash.one_of_each(df.repartition(3)).collect()))


def test_simhash_links_fingerprints_of_rows_without_an_id(spark, monkeypatch):
    prints = {"a": 0b1, "b": 0b111, "c": 0b11111}
    monkeypatch.setattr(simhash, "_scan_fingerprints", lambda texts: [__import__("pyarrow").array([{"a": 0b1, "b": 0b111, "c": 0b11111}[t] for t in texts], "int64")])
    df = spark.createDataFrame([(8, "a"), (None, "b"), (2, "c")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == {8: 2, None: 2, 2: 2} and len(prints) == 3


#: Notices and prose that the classifier does not learn from, and what they are.
HELD = [
    ("Licensed under the ISC License.", "isc"),
    ("EUPL-1.2", "eupl"),
    ("This software is licensed under EUPL 1.2", "eupl"),
    ("Apache-2.0", "apache-2.0"),
    ("GPLv3", "gpl-3.0"),
    ("This project is available under the MIT license", "mit"),
    ("Code released under the MIT license, see file.", "mit"),
    ("The library is distributed under the terms of the Apache License, version 2.0", "apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Released under the MIT License.", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("All rights reserved.", "all-rights-reserved"),
    ("The code is under the 3-clause BSD license.", "bsd"),
    ("BSD 2-Clause \"Simplified\" License", "bsd"),
    ("This file is part of a project licensed under GPL version 2 or later", "gpl-2.0"),
    ("Published under Creative Commons Attribution ShareAlike 4.0", "cc-by-sa"),
    ("Images: CC BY 4.0", "cc-by"),
    ("Text is licensed CC BY-ND 3.0", "cc-by-nd"),
    ("dual licensed under MPL-2.0", "mpl-2.0"),
    ("This code is covered by the Mozilla Public License 2.0", "mpl-2.0"),
    ("licensed under the Eclipse Public License, v2", "epl"),
    ("LGPL-2.1-or-later", "lgpl"),
    ("GNU Lesser General Public License v3", "lgpl"),
    ("GNU Affero General Public License v3.0 or later", "agpl-3.0"),
    ("Released to the public domain under CC0 1.0", "cc0"),
    ("This package is under the zlib license", "zlib"),
    ("Boost license 1.0", "bsl-1.0"),
    ("Distributed under the WTFPL", "wtfpl"),
    ("The Unlicense", "unlicense"),
    ("CDDL-1.1", "cddl"),
    ("Artistic-2.0", "artistic-2.0"),
    ("(c) 2019 The Firm. All Rights Reserved.", "all-rights-reserved"),
    ("CODE LICENSE: GPL-3.0", "gpl-3.0"),
    ("Freely available under the Apache 2 licence", "apache-2.0"),
    ("You may use it under the terms of the GNU LGPL, version 3", "lgpl"),
    ("MIT-licensed, see LICENSE", "mit"),
    ("The docs are CC BY-SA 3.0", "cc-by-sa"),
    ("Eclipse Public License - v 1.0", "epl"),
    ("Mozilla Public License Version 1.1", "mpl-2.0"),
    ("under the GNU GPL version 3", "gpl-3.0"),
    ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "gpl-2.0"),
    ("Licensed under the Open Widget License 3.1", "unknown"),
    ("the Zorp licence applies to this file", "unknown"),
    ("The public house lost its license in 1990.", "none"),
    ("version 3 of the report was released under protest", "none"),
    ("He distributed the files to the general staff.", "none"),
    ("Licensed under the Frobozz License.", "unknown"),
    ("Released under the Quux Public License, version 4.", "unknown"),
    ("Distributed under the terms of the Acme license", "unknown"),
    ("SPDX-License-Identifier: Foo-1.0", "unknown"),
    ("Copyright law protects authors of books.", "none"),
    ("The license plate was dirty.", "none"),
    ("My driving license expires in May.", "none"),
    ("MIT is a university in Cambridge.", "none"),
    ("He asked permission to leave.", "none"),
    ("The eclipse lasted four minutes.", "none"),
    ("The public was free to visit the commons.", "none"),
    ("A general published his memoirs.", "none"),
    ("She studied the copyright of songs.", "none"),
    ("They reserved a table with all rights of guests.", "none"),
    ("The warranty covers two years.", "none"),
    ("Apache tribes lived in the area.", "none"),
    ("The board granted a licence to the radio station.", "none"),
    ("Her software sorts the files.", "none"),
]


def judged_by_hand(text):
    """(family, score, confirmed) of a unit, in Python."""
    families, weights, bias = licenses.fit()
    z = np.array(bias) + sum((np.array(weights[g]) for g in licenses.grams_of(text) if g in weights), np.zeros(len(bias)))
    family, score, words = families[int(z.argmax())], float(1 / np.exp(z - z.max()).sum()), set(licenses.words_of(text))
    enough = lambda some: len(some & words) >= math.ceil(len(some) * licenses.CONFIRM)
    sure = family == licenses.NONE or score >= licenses.CERTAIN
    said, grant = f" {' '.join(licenses.words_of(text))} ", bool(re.search(licenses.CUE, text.lower()))
    held, also = False, []
    if family not in (licenses.NONE, licenses.UNKNOWN):
        alike = [t for t in licenses.TEMPLATES[family] if enough(set(licenses.words_of(t))) and enough(licenses.telling()[t])]
        named = [p for p in licenses.phrases()[family] if p in said]
        bare = any(len(p.split()) >= len(said.split()) * licenses.BARE for p in named)
        beside = any(f" {w}{p}" in said or f"{p}{w} " in said for p in named for w in licenses.BESIDE)
        held = any(len(set(licenses.words_of(t))) >= licenses.LONG for t in alike) or bool(grant and named and (alike or beside)) or bool(alike and bare)
        if grant and re.search(licenses.JOINED, text.lower()):
            also = [f for f in licenses.phrases() if f != family and any(p in said for p in licenses.phrases()[f])]
    sure = sure or bool(also)
    return (family if sure else licenses.UNKNOWN), score, sure and held


def test_licenses_on_notices_not_learned_from(spark):
    learned = {" ".join(licenses.words_of(t)) for _, t in licenses._forms()}
    held = [(t, y) for t, y in HELD if " ".join(licenses.words_of(t)) not in learned]
    assert len(held) > 50
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(held)], "doc_id long, text string")).collect()}
    found = [(got[i].families or licenses.NONE, y, got[i].confirmed) for i, (_, y) in enumerate(held)]
    named = lambda y: y not in (licenses.NONE, licenses.UNKNOWN)
    right = sum(f == y for f, y, _ in found if named(y))
    assert right / sum(named(y) for _, y, _ in found) >= 0.9 and right / sum(named(f) for f, _, _ in found) >= 0.9
    assert sum(f == y for f, y, _ in found) / len(found) >= 0.9
    assert not [x for x in found if x[2] and x[0] != x[1]]  # what is confirmed is right


def test_licenses_against_python(spark):
    units = [t for t, _ in HELD] + [t for texts in licenses.TEMPLATES.values() for t in texts]
    df = spark.createDataFrame([(t,) for t in units], "t string").select("t", licenses.classify(F.col("t")).alias("x"))
    for r in df.collect():
        family, score, confirmed = judged_by_hand(r.t)
        assert (r.x.family, r.x.confirmed) == (family, confirmed) and r.x.score == pytest.approx(score), r.t


def test_licenses_of_the_tables(spark):
    """Every licence line of the tables is found and confirmed, none of which stands among the templates letter for letter, and no other text has one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sign = re.compile(r"licen[sc]e|all rights reserved", re.I)
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    lines = {r.doc_id: [x for x in r.text.split("\n") if sign.search(x)] for r in docs.where("text is not null").collect()}
    assert not {x.strip() for ls in lines.values() for x in ls} & {t for texts in licenses.TEMPLATES.values() for t in texts}
    some = {i for i, ls in lines.items() if ls}
    assert some and {i for i, r in got.items() if r.n_notices and r.confirmed} == some


def test_redaction_hides_what_find_lists(spark):
    rng = np.random.default_rng(8)
    parts = ["a", "1", "12", ".", "@", "+", "-", " ", "é", "😀", "4111 1111 1111 1111", "a@b.c", "1.2.3.4", "+1 (988) 555-2485", "DE89 3704 0044 0532 0130 00", "call (555) 123-4567", "ssn 123-45-6789", "\n", "378282246310005"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(300)] + ["é a@b.co 1.2.3.4, " * 700, "", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pw_all string")
    spans = {r.doc_id: r.spans for r in personal_data.find(df).collect()}
    hidden = personal_data.redacted(df)
    assert hidden.columns == df.columns
    for r in hidden.collect():
        t, out, at = texts[r.doc_id], "", 0
        for s in filter(None, spans[r.doc_id].split(",")):
            kind, start, stop = s.split(":")[0], *map(int, s.split(":")[1:])
            if start >= at:
                out += t[at:start] + f"[{kind.upper()}]"
            at = max(at, stop)
        assert r.text == (None if t is None else out + t[at:])


def test_mixing_gives_the_nearest_rates(spark):
    """Brute force: Dykstra's projections of rates 1 on the half-lines r >= 0 and on the totals, in the norm weighted by tokens."""
    rng = np.random.default_rng(6)
    p, n = rng.dirichlet([1, 1, 0.3], 40), rng.integers(1, 60, 40)
    want = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]) * n.sum()
    a = p.T * n
    r, held = np.ones(40), np.zeros(40)
    gram = np.linalg.inv(a / n @ a.T)
    for _ in range(200_000):
        y = r - (a / n).T @ (gram @ (a @ r - want))
        r, held = np.maximum(0, y + held), np.minimum(0, y + held)
        if np.abs(a @ r - want).max() < 1e-10 * n.sum():
            break
    members = spark.createDataFrame([(int(k), row) for k, row in zip(n, p.tolist(), strict=True)], "n_tokens long, p array<double>")
    x = mixing.fit_rates(members, mixing.TARGETS)
    assert np.maximum(0, p @ x) == pytest.approx(r, abs=1e-5)


def test_mixture_tells_what_it_misses(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    assert {r.mix_residual for r in mixing.mixed(docs, labels, tell=True).select("mix_residual").distinct().collect()}.pop() <= 1e-6
    with pytest.warns(UserWarning, match="do not reach"):
        rows = mixing.mixed(docs.limit(3), labels.where("false"), {"high": 1.0}, tell=True).collect()
    assert rows and all(r.mix_residual == pytest.approx(2 / 3, abs=1e-3) for r in rows)


def newton(n, p, want):
    """The same rates by another way: Newton steps with halving on the smooth dual function."""
    x, tokens = np.ones(p.shape[1]), n.sum()

    def at(x):
        r = np.maximum(0, p @ x)
        return (n * r * r).sum() / tokens / 2 - x @ want, (n * r) @ p / tokens - want, (p.T * (n * (r > 0))) @ p / tokens

    value, slope, h = at(x)
    for _ in range(200):
        if np.abs(slope).sum() < 1e-11:
            break
        step, part = -np.linalg.solve(h + 1e-12 * np.eye(len(x)), slope), 1.0
        while part > 1e-9 and (new := at(x + part * step))[0] > value + 1e-4 * part * (slope @ step) and abs(new[1] @ step) > 0.5 * abs(slope @ step):
            part /= 2
        x, (value, slope, h) = x + part * step, new
    return np.maximum(0, p @ x)


@pytest.mark.parametrize("case", ["spread", "narrow", "few", "documents"])
def test_projected_gradient_gives_the_rates_of_newton_steps(spark, case):
    rng = np.random.default_rng(0)
    if case == "documents":
        docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
        members = mixing.memberships(docs, labels)
        rows = members.select("n_tokens", "p").collect()
        n, p = np.array([r.n_tokens for r in rows], float), np.array([r.p for r in rows])
    else:
        z = rng.normal(size=(2000 if case != "few" else 60, 3)) * (1.0 if case == "narrow" else 3.0) + [0, 0.5, -0.5]
        p, n = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True), 1.0 + np.arange(len(z)) % 97
        members = spark.createDataFrame([(int(k), row) for k, row in zip(n, p.tolist(), strict=True)], "n_tokens long, p array<double>")
    want = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    x = mixing.fit_rates(members, mixing.TARGETS)
    assert np.maximum(0, p @ x) == pytest.approx(newton(n, p, want), abs=1e-5 * max(1.0, np.abs(p @ x).max()))


def test_near_duplicate_blocks_share_their_elements():
    blocks = main_text.blocks_of("<div><section><p>a</p><p>b</p></section><ul><li>c<li>d</ul></div>" + "<div>" * 100 + "<p>e</p><p>f</p>")
    assert [(b.text, b.common, b.depth) for b in blocks] == [("a", 0, 3), ("b", 2, 3), ("c", 1, 3), ("d", 2, 3), ("e", 0, 101), ("f", 100, 101)]


def test_language_scores_against_one_gram_at_a_time():
    """The score of a text under a given model, by counting n-grams one by one."""
    rng = np.random.default_rng(1)
    width = 1 << language_id.BITS
    model = language_id.LanguageModel(["a", "b", "c"], rng.random(width).astype(np.float32), rng.normal(size=(width, 3)).astype(np.float32), rng.normal(size=3), 0.7)

    def bucket(gram):
        h = len(gram)
        for c in gram:
            h = h * 0x01000193 % 2**32 ^ ord(c)
        return h * 0x9E3779B1 % 2**32 >> 32 - language_id.BITS

    for text in ["x", "Ab", "Grüße 😀 an alle", "word " * 50, "l" * (language_id.SHORT + 5) + "m"]:
        grams = [text.lower()[i : i + n] for n in language_id.ORDERS for i in range(len(text.lower()) - n + 1)]
        counts = {}
        for g in grams:
            counts[bucket(g)] = counts.get(bucket(g), 0) + 1
        x = {k: math.log1p(n) * float(model.idf[k]) for k, n in counts.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        z = sum(v / size * model.weights[k].astype(float) for k, v in x.items()) + model.bias
        p = language_id.softmax(z / 0.7)
        lang, score = model.predict(text)
        assert lang == model.languages[int(p.argmax())] and score == pytest.approx(p.max())
