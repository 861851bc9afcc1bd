"""Queries of documents, key-value lines, paths, JSON lines and Python's values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions.python_values import py_round
from ..functions.results import is_object
from ..functions.text import last_marker
from ..registry import query
from ..sources import jsonl
from ..sources.fixtures import table, view

_PREFIX = "CASE (doc_id + line_no) % 9 WHEN 0 THEN '## ' WHEN 1 THEN '### ' WHEN 2 THEN '#### ' WHEN 3 THEN '> ' WHEN 4 THEN '- ' WHEN 5 THEN '1. ' WHEN 6 THEN '# ' WHEN 7 THEN '```' ELSE '' END"
_LINES = f"SELECT doc_id, CAST(i - 1 AS INT) AS line_no, ls[i] AS raw FROM (SELECT doc_id, string_split(text, '\n') AS ls, unnest(generate_series(1, len(string_split(text, '\n')))) AS i FROM documents)"
_STATE = f"SELECT *, sum(CAST(starts_with(line, '```') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, line_no, trim(concat({_PREFIX}, raw), ' \t\r\x0b\x0c') AS line, concat({_PREFIX}, raw) AS full_line FROM ({_LINES}))"


@query(f"""WITH st AS ({_STATE}) SELECT doc_id, kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
  SELECT doc_id, CASE WHEN starts_with(line, '## ') THEN 'heading1' WHEN starts_with(line, '### ') THEN 'heading2' WHEN starts_with(line, '#### ') THEN 'heading3' WHEN starts_with(line, '> ') THEN 'quote' WHEN starts_with(line, '- ') THEN 'bullet' WHEN starts_with(line, '1. ') THEN 'ordered' ELSE 'text' END AS kind,
    trim(regexp_replace(line, '^(## |### |#### |> |- |1\\.\\s+)', ''), ' \t\r\x0b\x0c') AS text FROM st WHERE fences % 2 = 0 AND NOT starts_with(line, '```') AND line <> '' AND NOT starts_with(line, '# ')
  UNION ALL SELECT doc_id, 'code', coalesce(string_agg(rtrim(full_line, ' \t'), '\n' ORDER BY line_no) FILTER (WHERE NOT starts_with(line, '```')), '') FROM st WHERE fences % 2 = 1 GROUP BY doc_id, fences
    HAVING count(*) FILTER (WHERE NOT starts_with(line, '```')) > 0 OR fences < (SELECT max(t.fences) FROM st AS t WHERE t.doc_id = st.doc_id)) GROUP BY doc_id, kind""")
def md_parse(s, d):
    """Nodes of each document by kind, code blocks as one node each."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.element_at(F.array(*[F.lit(p) for p in ("## ", "### ", "#### ", "> ", "- ", "1. ", "# ", "```", "")]), ((F.col("doc_id") + i) % 9 + 1).cast("int")), x))
    nodes = table(s, d, "documents").select("doc_id", F.explode(D.markdown_nodes(F.array_join(marked, "\n"))).alias("x"))
    return nodes.groupBy("doc_id", F.col("x.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("x.text")).alias("chars"))


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS name, c_mktsegment AS segment, CAST(2 AS INT) AS n FROM customer")
def kv_lines(s, d):
    text = F.concat(F.lit('# note = 1\nname = "'), "c_name", F.lit("\"\n\nsegment: '"), "c_mktsegment", F.lit("'\nno value\n name ="), F.col("c_custkey").cast("string"))
    got = table(s, d, "customer").select("c_custkey", D.key_values(text).alias("m"))
    return got.select("c_custkey", F.col("m")["name"].alias("name"), F.col("m")["segment"].alias("segment"), F.size("m").alias("n"))


@query("SELECT doc_id, lang, doc_id % 4 <> 0 AND doc_id % 4 <> 3 AS is_path FROM documents")
def path_classify(s, d):
    value = F.expr("CASE doc_id % 4 WHEN 0 THEN concat('https://x.org/', doc_id, '.json') WHEN 1 THEN concat('runs', '/', doc_id) WHEN 2 THEN concat(doc_id, '.yaml') ELSE concat('word ', doc_id) END")
    return table(s, d, "documents").select("doc_id", "lang", D.looks_like_path(value).alias("is_path"))


@query("SELECT event_id, user_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS props FROM events")
def scan_jsonl(s, d):
    """Events written as JSON lines and read back."""
    path = jsonl.scratch(s, "jsonl")
    jsonl.write(table(s, d, "events").select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("props")), path)
    return jsonl.read(s, path, "event_id long, user_id long, event_type string, props string", ("event_id",))


@query("SELECT template_name, round_even(CAST(sum(process_c) AS DOUBLE) / 8, 2) AS score FROM trajectories GROUP BY template_name", "trajectories")
def py_round_scores(s, d):
    """Eighths of a sum in Python's rounding."""
    got = view(s, d, "trajectories").groupBy("template_name").agg((F.sum("process_c").cast("double") / 8).alias("x"))
    return got.select("template_name", py_round(F.col("x"), 2).alias("score"))


@query("SELECT event_id, CASE WHEN event_id % 16 NOT IN (0, 3, 6, 15) THEN TRUE ELSE FALSE END AS is_object FROM events")
def parse_result(s, d):
    return view(s, d, "executions").select("event_id", is_object(last_marker(F.col("stdout"))).alias("is_object"))


@query("SELECT status, concat(CAST(n * 1000 // total // 10 AS VARCHAR), '.', CAST(n * 1000 // total % 10 AS VARCHAR), '%') AS share FROM (SELECT status, count(*) AS n, sum(count(*)) OVER () AS total FROM trajectories GROUP BY status)", "trajectories")
def fmt_metrics(s, d):
    """Shares in percent, cut to tenths before they are formatted."""
    counts = view(s, d, "trajectories").groupBy("status").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("status", D.percent(F.expr("n * 1000 div total") / 1000).alias("share"))  # total is one row
