"""Every operator and every stage of the pipeline on hostile rows: nulls in any column, empty and very long texts, ties and repeated
rows, columns with clashing names, empty tables."""

import pytest
from pyspark.sql import functions as F

from pathwright.llm import decontamination, language_id, licenses, main_text, mixing, ngram_model, personal_data, queries, simhash, token_counts, topk

TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (5, "x" * 200_000 + " y"), (6, "one two three " * 20_000), (7, "Ünïcode 😀 Word\x00"), (8, "one two"), (9, "one two"), (None, "one two"), (None, None)]
#: Names that operators might use for columns of their own.
CLASHES = "n_tokens n_words n_hit rate mix_rate fp rep p v score lang_pred spans component_id fingerprint shard key keys x m text_ pw_gone part n kind held_out".split()


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame([(i, t, None if i in (2, 5) else "en", None if i == 3 else "web", 7) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return base.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, None), (None, "unknown words"), (3, "")], "item_id long, text string").withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 1, 0), (None, 1, 1), (8, None, 1), (9, 0, None), (77, 1, 0)], "doc_id long, quality int, toxic int").withColumns({c: F.lit("clash") for c in CLASHES})


def operators(bench, labels):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return {
        "ngrams": ngram_model.score_texts, "personal": personal_data.find, "mixing": lambda d: mixing.mix(d, labels), "benchmark": lambda d: decontamination.decontaminate(d, bench),
        "simhash": simhash.near_duplicates, "language": language_id.identify, "licenses": licenses.scan, "tokens": lambda d: token_counts.count_tokens(d, path),
    }


@pytest.mark.parametrize("name", ["ngrams", "personal", "mixing", "benchmark", "simhash", "language", "licenses", "tokens"])
def test_operators_give_one_row_a_row(spark, docs, bench, labels, name):
    run = operators(bench, labels)[name]
    ids = sorted(str(i) for i, _ in TEXTS)
    rows = run(docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == ids
    # rows that are alike get results that are alike
    twice = [r for r in rows if r.doc_id == 4]
    assert twice[0] == twice[1]
    assert run(docs.where("false")).collect() == []
    nothing = docs.withColumn("text", F.lit(None).cast("string"))
    assert len(run(nothing).collect()) == len(TEXTS)


def test_results_of_hard_rows(docs, bench, labels):
    o = operators(bench, labels)
    of = lambda name: {r.doc_id: r for r in o[name](docs).collect() if r.doc_id is not None}
    b = of("benchmark")
    assert (b[1].n_words, b[2].n_words, b[6].n_words, b[6].n_hit, b[8].n_hit) == (0, 0, 60_000, 60_000, 0) and b[6].n_items == 1
    s = of("simhash")
    # texts without words share fingerprint zero and are linked like any other
    assert {s[i].fingerprint for i in (1, 2, 3)} == {"0" * 16} and {s[i].component_id for i in (1, 2, 3)} == {1}
    assert s[8].component_id == s[9].component_id == 8 and s[4].component_id == 4
    assert {of("language")[i].lang_pred for i in (1, 2, 3)} == {"und"}
    p = of("personal")
    assert p[1].spans == p[2].spans == "" and p[5].n_email == 0
    t = of("tokens")
    assert (t[1].n_bytes, t[1].n_tokens, t[7].n_bytes) == (0, 0, len("Ünïcode 😀 Word\x00".encode()))


def test_pages(spark):
    article = "<article><p>" + "Words of an article go on here, and on. " * 8 + "</p></article>"
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", article), (4, "u", article), (None, None, article), (5, "u", "<div>" * 5_000 + "deep" + "</div>" * 5_000), (6, "u", "<p>" + "long text, and more of it. " * 20_000 + "</p>"), (7, "u", "a < b & c &amp &#0; &#xD800; &#99999999999; &nosuch;")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in [*CLASHES, "text"]})
    rows = main_text.extract(df).collect()
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    by = {r.page_id: r for r in rows}
    assert [by[i].text for i in (1, 2, 3)] == ["", "", ""]
    assert by[6].text == ("long text, and more of it. " * 20_000).strip()
    assert by[4].text == by[None].text == ("Words of an article go on here, and on. " * 8).strip()
    assert main_text.extract(df.where("false")).collect() == []


def test_vectors_with_clashing_columns(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, []), (100, None)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in [*CLASHES, "rank", "query_id"]})
    got = topk.exact_top_k(e, e.where("vec_id % 50 = 0"), 5).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == [(0, 1, 1, 256 * 128), (0, 2, 1, 256 * 128), (0, 3, 50, 0), (50, 1, 1, 256 * 128), (50, 2, 1, 256 * 128), (50, 3, 0, 0)]


def test_stages_keep_the_columns(spark, docs, bench, labels, tmp_path):
    corpus = pytest.importorskip("corpus_pipeline")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    names = dict(corpus.STAGES)
    after = lambda name, d: names[name](spark, d, str(tmp_path))
    for name, stage in corpus.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns[: len(docs.columns)] == docs.columns, name
        assert got.where("n_hit <> 'clash' or rate <> 'clash'").count() == 0, name
        assert stage(spark, docs.where("false"), str(tmp_path)).collect() == [], name
    # one document of each group: texts without words are a group, as are equal texts with and without an id
    left = [r.doc_id for r in after("near_duplicates", docs).collect()]
    assert left.count(4) == 1 and left.count(1) == 1 and not {2, 3, 9, None} & set(left) and {5, 6, 7, 8} <= set(left)
    assert sorted(str(r.doc_id) for r in after("benchmark", docs).collect()) == sorted(str(i) for i, _ in TEXTS if i != 6)
    hidden = {r.doc_id: r for r in after("private", docs).collect()}
    assert hidden[1].text is None and hidden[1].n_chars is None and hidden[7].n_chars == len("Ünïcode 😀 Word\x00") and hidden[5].n_chars == 200_002


def test_queries_are_thirteen():
    assert len(queries.queries()) == 13
