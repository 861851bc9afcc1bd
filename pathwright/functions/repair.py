"""Repair of extracted code, as column expressions. Each step's value is bound once, so that the plan grows with the number of steps only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LINE_ENDS, MARKER, code_start, delimiter_balance, extract_code, strip

NAME = MARKER.removesuffix("=")

#: Old names of a knapsack module, and their new ones.
RENAMES = [
    ("from ortools.algorithms import pywrapknapsack_solver", "from ortools.algorithms.python import knapsack_solver"),
    ("pywrapknapsack_solver.KnapsackSolver(", "knapsack_solver.KnapsackSolver("),
    ("pywrapknapsack_solver.KnapsackSolver.KNAPSACK_DYNAMIC_PROGRAMMING_SOLVER", "knapsack_solver.SolverType.KNAPSACK_DYNAMIC_PROGRAMMING_SOLVER"),
]
#: What marks the old module, and the calls that change with it.
LEGACY = ["pywrapknapsack_solver", "knapsack_solver.KnapsackSolver"]
LEGACY_INIT = (r"\.Init\(([^,]+),\s*([^,]+),\s*len\([^)]+\),\s*([^)]+)\)", ".init($1, $2, $3)")
LEGACY_CALLS = [(".Init(", ".init("), ("optimal_value = solver.OptimalValue()", "optimal_value = solver.solve()"), ("solver.Solve()", "solver.solve()"), (".BestSolutionContains(", ".best_solution_contains(")]
#: Calls of other solvers' interfaces, and the ones meant.
REWRITES = [
    (r"solver\.Value\(([^)]+)\)", "$1.solution_value()"),
    (r"solver\.status_name\(\)", "_status_text(status)"),
    (r"solver\.StatusName\(([^)]+)\)", "_status_text($1)"),
    (r"\bval\.value\(\)", "val.solution_value()"),
    (r"\bvar\.value\(\)", "var.solution_value()"),
    (r"\bx\.value\(\)", "x.solution_value()"),
    (r"\bsolver\.Dispose\(\)", ""),
]
#: Before which lines a missing call to solve belongs, by preference.
SOLVE_BEFORE = [r"(?m)^status\s*=", r"(?m)^status_name\s*=", r"(?m)^result\s*="]
SOLVE = "status = solver.Solve()\n"
#: Modules that code uses without importing them; each import goes above those before it.
IMPORTS = [("ortools.linear_solver", "pywraplp"), ("ortools.sat.python", "cp_model"), ("ortools.constraint_solver", "pywrapcp"), ("ortools.constraint_solver", "routing_enums_pb2")]

PREAMBLE = '''import json

_STATUS_HOMES = (("ortools.linear_solver.pywraplp", "Solver"), ("ortools.sat.python.cp_model", None))


def _status_text(code):
    import importlib

    for module, holder in _STATUS_HOMES:
        try:
            names = importlib.import_module(module)
        except ImportError:
            continue
        names = getattr(names, holder) if holder else names
        for word in ("OPTIMAL", "FEASIBLE"):
            if code == getattr(names, word, object()):
                return word
    return str(code)


def _attempt(call):
    try:
        return call()
    except Exception:
        return None


def _result_of(scope):
    given = scope.get("result")
    if isinstance(given, dict):
        return {"status": _status_text(given.get("status")), "objective_value": given.get("objective_value")}
    value = _attempt(lambda: float(scope["solution"].ObjectiveValue()))
    if value is not None:
        return {"status": "OPTIMAL", "objective_value": value}
    status, value = scope.get("status"), scope.get("objective_value")
    if status is None:
        status = _attempt(lambda: scope["solver"].Solve())
    if value is None:
        value = _attempt(lambda: scope["solver"].Objective().Value())
    return {"status": _status_text(status), "objective_value": value}'''
PRINT = f'print("{MARKER}" + json.dumps(_result_of({{**globals(), **locals()}}), ensure_ascii=False))'
FOOTER = f'''try:
    {PRINT}
except Exception as error:
    print("{MARKER}" + json.dumps({{"status": "FAILED", "objective_value": None, "error": str(error)}}, ensure_ascii=False))'''


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def chain(value: Column, *steps: Callable[[Column], Column]) -> Column:
    for step in steps:
        value = let(value, step)
    return value


def _replace(pairs: list[tuple[str, str]]) -> Callable[[Column], Column]:
    def step(t: Column) -> Column:
        for old, new in pairs:
            t = F.replace(t, F.lit(old), F.lit(new))
        return t

    return step


def _cut(t: Column) -> Column:
    return let(code_start(t), lambda at: F.when(at.isNull(), t).otherwise(strip(F.substr(t, at + 1))))


def _fold(t: Column) -> Column:
    """Leaves out step tags, and puts one print in place of each statement that names the marker, over all lines of its brackets.
    The fold gives one letter a line (keep, drop, print), so long texts stay cheap."""

    def mark(state: Column, line: Column) -> Column:
        tag = strip(line).isin("<step>", "</step>")
        inside, named = state["open"] > 0, F.contains(line, F.lit(NAME))
        letter = F.when(inside | tag, "d").when(named, "p").otherwise("k")
        opened = F.when(inside, state["open"] + delimiter_balance(line)).when(named & ~tag, delimiter_balance(line)).otherwise(0)
        return F.struct(F.greatest(opened, F.lit(0)).cast("int").alias("open"), F.concat(state["letters"], letter).alias("letters"))

    def folded(lines: Column) -> Column:
        letters = F.split(F.aggregate(lines, F.struct(F.lit(0).alias("open"), F.lit("").alias("letters")), mark)["letters"], "")
        kept = F.filter(F.arrays_zip(lines.alias("line"), letters.alias("letter")), lambda x: (x["letter"] != "d") & x["line"].isNotNull())
        return F.array_join(F.transform(kept, lambda x: F.when(x["letter"] == "p", F.concat(F.regexp_extract(x["line"], r"^\s*", 0), F.lit(PRINT))).otherwise(x["line"])), "\n")

    special = F.contains(t, F.lit(NAME)) | F.contains(t, F.lit("step>"))
    return strip(F.when(special, let(F.split(t, LINE_ENDS), folded)).otherwise(F.regexp_replace(t, LINE_ENDS, "\n")))


def _upgrade(t: Column) -> Column:
    legacy = F.contains(t, F.lit(LEGACY[0])) | F.contains(t, F.lit(LEGACY[1]))
    return let(_replace(RENAMES)(t), lambda x: F.when(legacy, _replace(LEGACY_CALLS)(F.regexp_replace(x, *LEGACY_INIT))).otherwise(x))


def _rewrite(t: Column) -> Column:
    for pattern, new in REWRITES:
        t = F.regexp_replace(t, pattern, new)
    return t


def _solved(t: Column) -> Column:
    has = lambda x: F.contains(t, F.lit(x))
    place = F.coalesce(*[F.when(t.rlike(p), F.length(F.get(F.split(t, p, 2), F.lit(0)))) for p in SOLVE_BEFORE])
    added = let(place, lambda at: F.when(at.isNull(), F.concat(t, F.lit("\n" + SOLVE))).otherwise(F.concat(F.substr(t, F.lit(1), at), F.lit(SOLVE), F.substr(t, at + 1))))
    return strip(F.when(~has("solver.Solve()") & (has("solver.Maximize(") | has("solver.Minimize(")), added).otherwise(t))


def repair(code: Column) -> Column:
    """Code with old and foreign solver calls replaced, and a call to solve where an objective has none."""
    return chain(code, _upgrade, _rewrite, _solved)


def _imported(t: Column) -> Column:
    def one(module: str, name: str) -> Callable[[Column], Column]:
        line, dotted = f"from {module} import {name}", module.replace(".", r"\.")
        return lambda x: F.when(x.rlike(rf"\b{name}\b") & ~x.rlike(rf"(?m)^from\s+{dotted}\s+import\s+{name}"), F.concat(F.lit(line + "\n"), x)).otherwise(x)

    return chain(t, *[one(*x) for x in IMPORTS])


def runnable(code: Column) -> Column:
    """Repaired code with its missing imports, the helpers above it, and a print of the result below it unless it has one. Never empty."""
    with_helpers = lambda t: F.concat(F.lit(PREAMBLE + "\n\n"), t)
    footed = lambda t: strip(F.when(F.contains(t, F.lit(MARKER)), t).otherwise(F.concat(F.rtrim(t), F.lit("\n\n" + FOOTER))))
    return chain(code, _imported, footed, with_helpers)


def postprocess(code: Column) -> Column:
    """Extracted code made runnable: tag and stray fences off, prose before the first line of code cut, step tags and result prints normalised."""
    bare = lambda t: strip(F.replace(F.regexp_replace(t, r"(?i)^python\s*\n", ""), F.lit("```"), F.lit("")))
    return runnable(repair(chain(strip(F.replace(code, F.lit("\r\n"), F.lit("\n"))), bare, _cut, _fold)))


def answer_code(response: Column) -> Column:
    """The runnable code of a whole answer; null for null."""
    return let(extract_code(response), postprocess)
