"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontamination, divergence, language_id, licenses, line_dedup, main_text, mixing, ngram_model, personal_data, simhash, token_counts, topk
from .common import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op2_ngram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_model.score_texts(load(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(load(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(load(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(load(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    ten = (op1_exact_top_k, op2_ngram_model, op3_personal_data, op4_main_text, op5_mixing, op6_decontamination, op7_simhash, op8_language_id, op9_licenses, op10_token_counts)
    return {f.__name__: f for f in (*ten, op11_source_divergence, op12_collocations, op13_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_top_k": OP1_SQL, "op6_decontamination": OP6_SQL, "op11_source_divergence": OP11_SQL, "op12_collocations": OP12_SQL, "op13_line_dedup": OP13_SQL}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
WHERE place <= 5
"""

#: Windows of every length that an item's windows have, compared as word lists.
OP6_SQL = """
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
pattern AS (
  SELECT item_id, least(10, len(w)) AS m, array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') AS p
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT m FROM pattern),
place AS (
  SELECT r, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') AS p
  FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM doc, size WHERE len(w) >= m)),
hit AS (SELECT r, item_id, place.m, s FROM place JOIN pattern ON place.m = pattern.m AND place.p = pattern.p),
marked AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + m - 1)) AS i FROM hit) GROUP BY r),
owned AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN marked USING (r) LEFT JOIN owned USING (r)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
occ AS (SELECT r, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS c FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
groups AS (SELECT DISTINCT lang, source FROM doc),
cell AS (
  SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c
  FROM groups AS g JOIN kept AS k USING (lang)
  LEFT JOIN (SELECT lang, source, term, count(*) AS c FROM occ GROUP BY lang, source, term) AS o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
vn AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
gn AS (SELECT lang, source, sum(c) AS n FROM cell GROUP BY lang, source),
p AS (
  SELECT cell.lang, cell.source, cell.term, cell.c, CAST(1 + CAST(1000000000 * CAST(cell.c + 2 AS HUGEINT) // CAST(gn.n + 2 * vn.v AS HUGEINT) AS HUGEINT) AS BIGINT) AS p,
    CAST(1 + CAST(1000000000 * CAST(kept.c + 2 AS HUGEINT) // CAST(vn.n + 2 * vn.v AS HUGEINT) AS HUGEINT) AS BIGINT) AS q
  FROM cell JOIN gn USING (lang, source) JOIN vn USING (lang) JOIN kept ON kept.lang = cell.lang AND kept.term = cell.term),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(CASE WHEN x.p IS NULL THEN 0 ELSE (x.p - y.p) * (x.p - y.p) // (x.p + y.p) END), 0) AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p AS x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p AS y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

#: All phrases of up to three words of each piece, and both ways to cut the longer ones.
OP12_SQL = f"""
WITH piece AS (
  SELECT row_number() OVER () AS r, lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
word AS (SELECT r, lang, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM piece),
follow AS (SELECT lang, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM word WINDOW o AS (PARTITION BY r ORDER BY i)),
gram AS (
  SELECT lang, 1 AS size, [x] AS p, count(*) AS f FROM follow GROUP BY lang, x
  UNION ALL SELECT lang, 2, [x, y], count(*) FROM follow WHERE y IS NOT NULL GROUP BY lang, x, y
  UNION ALL SELECT lang, 3, [x, y, z], count(*) FROM follow WHERE z IS NOT NULL GROUP BY lang, x, y, z),
total AS (SELECT lang, sum(f) AS n FROM gram WHERE size = 1 GROUP BY lang),
cand AS (SELECT * FROM gram WHERE size > 1 AND f >= 10),
cut AS (SELECT lang, size, p, f, k, list_slice(p, 1, k) AS x, list_slice(p, k + 1, size) AS y FROM cand, (VALUES (1), (2)) AS s(k) WHERE k < size),
scored AS (
  SELECT cut.*, a.f AS l, b.f AS r, CAST(1000000 AS HUGEINT) * cut.f * cut.f // (CAST(a.f AS HUGEINT) * b.f) AS score
  FROM cut JOIN gram AS a ON a.lang = cut.lang AND a.p = cut.x JOIN gram AS b ON b.lang = cut.lang AND b.p = cut.y),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (SELECT lang, list_slice(p, s, s + 1) AS p, max(f) AS f FROM cand, (VALUES (1), (2)) AS t(s) WHERE size = 3 GROUP BY ALL),
left_ AS (SELECT lowest.* FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND inside.p = lowest.p WHERE inside.f IS NULL OR 100 * inside.f < 50 * lowest.f)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(f AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, array_to_string(p, ' ')) AS rank FROM left_) JOIN total USING (lang)
WHERE rank <= 2000
"""

OP13_SQL = """
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS d, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT r, doc_id, d, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM doc),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
common AS (SELECT key, max(d) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT d) >= 3),
judged AS (SELECT keyed.*, common.key IS NOT NULL AND d < top AS gone FROM keyed LEFT JOIN common ON common.key = keyed.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
