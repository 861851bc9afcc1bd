"""The engine's functions under names of their own, for plain SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .python_values import SPACES, rounded_sql
from .results import KIND, in_python
from .text import CLOSED_FENCE, LINE_ENDS, MARKER, OPEN_FENCE, STEP_TITLES


def _text(s: str) -> str:
    """A literal."""
    return "'" + "".join(c if c.isascii() and c.isprintable() and c not in "'\\" else f"\\u{ord(c):04x}" for c in s) + "'"


_STRIP = "btrim({}, " + _text(SPACES) + ")"
_BARE = _STRIP.format("replace(response, '\\r\\n', '\\n')")
_HITS = " + ".join(f"CAST(contains(response, {_text(t)}) AS INT)" for t in STEP_TITLES)
_LAST = f"try_element_at(filter(split(stdout, {_text(LINE_ENDS)}), x -> startswith(x, {_text(MARKER)})), -1)"

FUNCTIONS = {
    # round() and strip() of Python
    "pw_round(x DOUBLE, places INT) RETURNS DOUBLE": rounded_sql("x", "places"),
    "pw_strip(t STRING) RETURNS STRING": _STRIP.format("t"),
    # the code of an answer
    "pw_code(response STRING) RETURNS STRING": _STRIP.format(f"coalesce(try_element_at(regexp_extract_all({_BARE}, {_text(CLOSED_FENCE)}, 1), -1), element_at(split({_BARE}, {_text(OPEN_FENCE)}), -1))"),
    # what a run printed as its result
    "pw_last_marker(stdout STRING) RETURNS STRING": _STRIP.format(f"substr({_LAST}, {len(MARKER) + 1})"),
    # ten-thousandths
    "pw_process_score(response STRING, execution_ok BOOLEAN, objective_match BOOLEAN) RETURNS INT": f"least(10000, ({_HITS}) * 375 + CASE WHEN execution_ok THEN 3500 ELSE 0 END + CASE WHEN objective_match THEN 3500 ELSE 0 END)",
    "pw_pair_weight(chosen_ok BOOLEAN, rejected_ok BOOLEAN, chosen_match BOOLEAN, rejected_match BOOLEAN, teacher_gap INT, process_gap INT) RETURNS BIGINT": "CAST(CASE WHEN chosen_ok AND NOT rejected_ok THEN 10000 WHEN chosen_match AND NOT rejected_match THEN 8500 WHEN teacher_gap > 0 THEN least(8000, 3500 + 450 * teacher_gap) ELSE least(8000, 3000 + greatest(500, 1000 * process_gap)) END AS BIGINT)",
    "pw_rationale(chosen_ok BOOLEAN, rejected_ok BOOLEAN, chosen_match BOOLEAN, rejected_match BOOLEAN, teacher_gap INT) RETURNS STRING": "CASE WHEN chosen_ok AND NOT rejected_ok THEN 'solver_success_beats_failure' WHEN chosen_match AND NOT rejected_match THEN 'objective_match_beats_mismatch' WHEN teacher_gap > 0 THEN 'teacher_score_gap' ELSE 'process_score_gap' END",
}


def register(spark: SparkSession) -> None:
    """Temporary functions of this session: those of FUNCTIONS, and pw_payload(payload), which reads a result payload as Python does (a struct of ok, status, objective_value; nulls for what is no object)."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("pw_payload", F.pandas_udf(in_python, KIND))
