"""Queries of code repair, packing and the preference loss."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import repair
from ..operators import training as T
from ..registry import query
from ..sources.fixtures import table, view


@query("SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN concat('x = v', doc_id, '.solution_value()\nsolver.Maximize(x)\nstatus = solver.Solve()\nstatus = 1') WHEN 1 THEN concat('x = v', doc_id, '.solution_value()\nsolver.Minimize(x)\nstatus = solver.Solve()') WHEN 2 THEN concat('x = v', doc_id, '.solution_value()\nsolver.Maximize(x)\nsolver.Solve()') WHEN 3 THEN concat('from ortools.algorithms.python import knapsack_solver\ns.init(a, w', doc_id, ', c)\nsolver.solve()') WHEN 4 THEN concat('t', doc_id, ' = _status_text(status)') WHEN 5 THEN concat('t = _status_text(v', doc_id, ')') WHEN 6 THEN concat('y', doc_id, ' = val.solution_value() + var.solution_value() + x.solution_value() + xx.value()') WHEN 7 THEN concat('a = ', doc_id) WHEN 8 THEN concat('import pywrapknapsack_solver\noptimal_value = solver.solve()\nb = s.best_solution_contains(', doc_id, ')') ELSE concat('from ortools.algorithms.python import knapsack_solver\nk = knapsack_solver.KnapsackSolver(knapsack_solver.SolverType.KNAPSACK_DYNAMIC_PROGRAMMING_SOLVER, \"', doc_id, '\")') END AS code FROM documents")
def repair_code(s, d):
    code = F.expr(r"""CASE doc_id % 10 WHEN 0 THEN concat('x = solver.Value(v', doc_id, ')\nsolver.Maximize(x)\nstatus = 1') WHEN 1 THEN concat('x = solver.Value(v', doc_id, ')\nsolver.Minimize(x)')
      WHEN 2 THEN concat('x = solver.Value(v', doc_id, ')\nsolver.Maximize(x)\nsolver.Solve()') WHEN 3 THEN concat('from ortools.algorithms import pywrapknapsack_solver\ns.Init(a, w', doc_id, ', len(z), c)\nsolver.Solve()') WHEN 4 THEN concat('t', doc_id, ' = solver.status_name()') WHEN 5 THEN concat('t = solver.StatusName(v', doc_id, ')')
      WHEN 6 THEN concat('y', doc_id, ' = val.value() + var.value() + x.value() + xx.value()') WHEN 7 THEN concat('a = ', doc_id, '\nsolver.Dispose()') WHEN 8 THEN concat('import pywrapknapsack_solver\noptimal_value = solver.OptimalValue()\nb = s.BestSolutionContains(', doc_id, ')')
      ELSE concat('from ortools.algorithms import pywrapknapsack_solver\nk = pywrapknapsack_solver.KnapsackSolver(pywrapknapsack_solver.KnapsackSolver.KNAPSACK_DYNAMIC_PROGRAMMING_SOLVER, "', doc_id, '")') END""")
    return table(s, d, "documents").select("doc_id", repair.repair(code).alias("code"))


@query()
def postprocess_code(s, d):
    """Runnable code of every answer; compared with a line-by-line version in the tests."""
    return view(s, d, "responses").select("doc_id", repair.answer_code(F.col("response")).alias("code"))


_IDS = lambda c: f"[2 + length(x) for x in string_split({c}, ' ')]"
_SIDE = lambda side: f"array_to_string(list_concat(prompt_ids, {side}_ids, [0 for x in range(width - n_{side})]), ' ') AS {side}_input_ids, array_to_string(list_concat([1 for x in range(n_{side})], [0 for x in range(width - n_{side})]), ' ') AS {side}_attention_mask, array_to_string(list_concat([-100 for x in prompt_ids], {side}_ids, [-100 for x in range(width - n_{side})]), ' ') AS {side}_labels"


@query(f"""SELECT problem_id, batch, {_SIDE('chosen')}, {_SIDE('rejected')} FROM (SELECT *, max(greatest(n_chosen, n_rejected)) OVER (PARTITION BY batch) AS width FROM (SELECT *, len(prompt_ids) + len(chosen_ids) AS n_chosen, len(prompt_ids) + len(rejected_ids) AS n_rejected FROM
  (SELECT problem_id, problem_id // 8 AS batch, list_slice({_IDS('question')}, 1, 6) AS prompt_ids, list_append(list_slice({_IDS('response')}, 1, 2), 1) AS chosen_ids, list_append(list_slice({_IDS("replace(template_name, '_', ' ')")}, 1, 2), 1) AS rejected_ids FROM dataset)))""", "dataset")
def token_pack(s, d):
    ids = lambda c: F.transform(F.split(c, " "), lambda x: F.length(x) + 2)
    cols = T.tokens_of_pair(ids(F.col("question")), ids(F.col("response")), ids(F.replace(F.col("template_name"), F.lit("_"), F.lit(" "))), 6, 2, 1)
    got = T.pack(view(s, d, "dataset").select("problem_id", *[c.alias(n) for n, c in cols.items()]), 8, 0, "problem_id")
    return got.select("problem_id", "batch", *[F.array_join(f"{side}_{f}", " ").alias(f"{side}_{f}") for side in ("chosen", "rejected") for f in ("input_ids", "attention_mask", "labels")])


_MEAN = lambda a: f"list_sum([-floor(abs(CAST(x AS DOUBLE)) * 1024) / 1024 for x in embedding[{a + 5}:{a + 16}]]) / 12"


@query(f"""SELECT batch, count(*) AS n, CAST(sum(CAST(round((1 + vec_id % 10) / 10.0 * (greatest(-z, 0.0) + ln(1 + exp(-abs(z)))) * 1e6) AS BIGINT)) AS BIGINT) AS loss_e6, count(*) FILTER (WHERE z > 0) AS right FROM
  (SELECT vec_id, vec_id // 32 AS batch, 0.5 * ((({_MEAN(0)}) - ({_MEAN(16)})) - (({_MEAN(32)}) - ({_MEAN(48)}))) AS z FROM embeddings) GROUP BY batch""".replace(" AS right", ' AS "right"'))
def dpo_loss(s, d):
    """The loss's sum in millionths a batch of 32, and the pairs ranked right; the first four places of each sequence are its prompt."""
    labels = F.array(*[F.lit(T.IGNORED if k < 4 else 1) for k in range(16)])
    logps = lambda a: F.transform(F.slice("embedding", a + 1, 16), lambda x: -F.floor(F.abs(x.cast("double")) * 1024) / 1024)
    t = T.preference_terms(*[T.mean_logp(logps(a), labels) for a in (0, 16, 32, 48)], (1 + F.col("vec_id") % 10) / 10, 0.5)
    got = table(s, d, "embeddings").select(F.expr("vec_id div 32").alias("batch"), F.round(t["loss"] * 1e6).cast("bigint").alias("l"), t["right"].alias("r"))
    return got.groupBy("batch").agg(F.count("*").alias("n"), F.sum("l").alias("loss_e6"), F.count_if("r").alias("right"))
