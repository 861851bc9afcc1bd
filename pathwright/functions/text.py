"""Text functions as column expressions: code extraction, process score, fences, result lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .python_values import strip

#: The headings that a structured answer has.
STEP_TITLES = ["Problem Description", "Sets and Parameters", "Decision Variables", "Objective Function", "Constraints", "Mathematical Model Summary", "Nonlinear Relationships", "Final Model and Implementation Considerations"]
#: Fenced code, an opening fence, and how a line of code may start.
CLOSED_FENCE = r"(?is)```(?:python|py)?\s*(.*?)```"
OPEN_FENCE = r"(?i)```(?:python|py)?\s*"
CODE_STARTS = [r"(?m)^import\s+\w+", r"(?m)^from\s+\w+\s+import\s+.+$", r"(?m)^def\s+\w+\s*\(", r"(?m)^model\s*=", r"(?m)^manager\s*=", r"(?m)^routing\s*=", r"(?m)^data\s*=\s*\{", r"(?m)^solver\s*=\s*"]
MARKER = "__RESULT__="
#: What ends a line of printed text.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def extract_code(response: Column) -> Column:
    """The last closed fence's content, else what follows the last opening fence, else the whole text; stripped."""
    text = strip(F.replace(response, F.lit("\r\n"), F.lit("\n")))
    closed = F.try_element_at(F.regexp_extract_all(text, F.lit(CLOSED_FENCE), F.lit(1)), F.lit(-1))
    after = F.element_at(F.split(text, OPEN_FENCE), -1)
    return strip(F.coalesce(closed, after))


def code_start(code: Column) -> Column:
    """Offset of the first line that looks like code; null if there is none."""
    first = lambda p: F.when(code.rlike(p), F.length(F.element_at(F.split(code, p, 2), 1)))
    return F.least(*[first(p) for p in CODE_STARTS])


def delimiter_balance(line: Column) -> Column:
    return F.length(F.regexp_replace(line, r"[^(\[{]", "")) - F.length(F.regexp_replace(line, r"[^)\]}]", ""))


def step_hits(response: Column) -> Column:
    return sum((F.contains(response, F.lit(t)).cast("int") for t in STEP_TITLES), F.lit(0))


def process_score_e4(response: Column, execution_ok: Column, objective_match: Column) -> Column:
    """The heuristic process score in ten-thousandths: 0.3 for all headings, 0.35 each for running and for matching."""
    return F.least(F.lit(10000), step_hits(response) * 375 + F.when(execution_ok, 3500).otherwise(0) + F.when(objective_match, 3500).otherwise(0))


def strip_json_fences(c: Column) -> Column:
    bare = F.regexp_replace(strip(c), r"^`+|`+$", "")
    return strip(F.when(F.lower(bare).startswith("json"), F.substr(bare, F.lit(5))).otherwise(bare))


def last_marker(stdout: Column) -> Column:
    """The payload of the last line that starts with the marker; null if there is none."""
    lines = F.filter(F.split(stdout, LINE_ENDS), lambda x: x.startswith(MARKER))
    return strip(F.substr(F.try_element_at(lines, F.lit(-1)), F.lit(len(MARKER) + 1)))
