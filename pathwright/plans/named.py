"""Queries in plain SQL over the named functions."""

from __future__ import annotations

from ..functions import named
from ..functions.python_values import SPACES
from ..registry import oracle_sql, query
from ..sources.fixtures import table, view
from . import misc  # noqa: F401 - some of its SQL serves here too

_CHARS = ", ".join(str(ord(c)) for c in SPACES)


def _sql(s, text, **views):
    named.register(s)
    return s.sql(text, **views)


@query(oracle_sql()["py_round_scores"])
def sql_round(s, d):
    return _sql(s, "SELECT template_name, pw_round(CAST(sum(process_c) AS DOUBLE) / 8, 2) AS score FROM {trajectories} GROUP BY template_name", trajectories=view(s, d, "trajectories"))


#: Each of Python's white spaces around a document and within it, and around code.
@query(f"SELECT doc_id, trim(text, array_to_string(list_transform([{_CHARS}], lambda k: chr(k)), '')) AS code FROM (SELECT doc_id, concat(chr(([{_CHARS}])[1 + doc_id % 29]), 'x', chr(([{_CHARS}])[1 + doc_id % 28]), coalesce(regexp_replace(text, '[`\r]', '', 'g'), ''), chr(([{_CHARS}])[1 + doc_id % 27])) AS text FROM documents)")
def sql_code(s, d):
    space = lambda k: "char_of[CAST(doc_id % {} AS INT)]".format(k)
    chars = "array(" + ", ".join(f"decode(unhex('{c.encode().hex()}'), 'UTF-8')" for c in SPACES) + ")"
    body = f"concat({space(29)}, 'x', {space(28)}, coalesce(regexp_replace(text, '[`\\r]', ''), ''), {space(27)})"
    return _sql(s, f"SELECT doc_id, pw_code(concat({space(29)}, '```python', {space(28)}, body, '```', {space(27)})) AS code FROM (SELECT doc_id, char_of, {body} AS body FROM (SELECT doc_id, text, {chars} AS char_of FROM {{documents}}))", documents=table(s, d, "documents"))


@query(oracle_sql()["parse_result"])
def sql_payload(s, d):
    return _sql(s, "SELECT event_id, coalesce(pw_payload(pw_last_marker(stdout)).ok, FALSE) AS is_object FROM {executions}", executions=view(s, d, "executions"))


@query(oracle_sql()["process_score"])
def sql_process_score(s, d):
    return _sql(s, "SELECT doc_id, pw_process_score(response, doc_id % 2 = 0, doc_id % 3 = 0) AS score_e4 FROM {responses}", responses=view(s, d, "responses"))


@query(oracle_sql()["pref_weights"])
def sql_weights(s, d):
    """Pairs by plain windows, weighed by the named functions."""
    ranked = "SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY CAST(success AS INT) DESC, CAST(objective_match AS INT) DESC, coalesce(teacher_c, 0) DESC, process_c DESC, pos) AS rank, count(*) OVER (PARTITION BY problem_id) AS n FROM {trajectories}"
    facts = "c.success, r.success, c.objective_match, r.objective_match, greatest(coalesce(c.teacher_c, 0) - coalesce(r.teacher_c, 0), 0)"
    return _sql(
        s,
        f"WITH ranked AS ({ranked}) SELECT c.problem_id, c.template_name, c.trajectory_id AS chosen_id, r.trajectory_id AS rejected_id, c.success AS chosen_success, pw_pair_weight({facts}, c.process_c - r.process_c) AS weight_e4, pw_rationale({facts}) AS rationale FROM ranked AS c JOIN ranked AS r ON c.problem_id = r.problem_id AND c.rank = 1 AND r.rank = r.n AND r.n >= 2",
        trajectories=view(s, d, "trajectories"),
    )
