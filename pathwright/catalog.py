"""The registry of queries for the engine's own operators, with their SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import config, prompts
from .functions import documents as D
from .functions import text as X
from .operators import decoding as decoding_ops
from .operators import history as H
from .operators import metrics as M
from .operators import optima as O
from .operators import ranking as R
from .operators import splits as S
from .operators import training as T
from .operators import verify as V
from .plans import datasets, factory, misc  # noqa: F401 - they register their queries
from .registry import oracle_sql, queries, query  # noqa: F401
from .sources.fixtures import table, view

RANKED = "SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY CAST(success AS INT) DESC, CAST(objective_match AS INT) DESC, coalesce(teacher_c, 0) DESC, process_c DESC, pos) AS rank, count(*) OVER (PARTITION BY problem_id) AS n FROM trajectories"
PAIRS = f"""SELECT c.problem_id, c.template_name, c.trajectory_id AS chosen_id, r.trajectory_id AS rejected_id, c.success AS cs, r.success AS rs, c.objective_match AS cm, r.objective_match AS rm,
  greatest(coalesce(c.teacher_c, 0) - coalesce(r.teacher_c, 0), 0) AS tg, c.process_c - r.process_c AS pg FROM ({RANKED}) AS c JOIN ({RANKED}) AS r ON c.problem_id = r.problem_id AND c.rank = 1 AND r.rank = r.n AND r.n >= 2"""
WEIGHED = f"""SELECT problem_id, template_name, chosen_id, rejected_id, cs AS chosen_success,
  CAST(CASE WHEN cs AND NOT rs THEN 10000 WHEN cm AND NOT rm THEN 8500 WHEN tg > 0 THEN least(8000, 3500 + 450 * tg) ELSE least(8000, 3000 + greatest(500, 1000 * pg)) END AS BIGINT) AS weight_e4,
  CASE WHEN cs AND NOT rs THEN 'solver_success_beats_failure' WHEN cm AND NOT rm THEN 'objective_match_beats_mismatch' WHEN tg > 0 THEN 'teacher_score_gap' ELSE 'process_score_gap' END AS rationale FROM ({PAIRS})"""
BEST = f"SELECT * FROM ({RANKED}) WHERE rank = 1"


def _weighed(s, d):
    return R.weigh(R.pairs(view(s, d, "trajectories")))


@query(f"SELECT problem_id, trajectory_id, pos, rank FROM ({RANKED})", "trajectories")
def rank_trajectories(s, d):
    return R.rank(view(s, d, "trajectories")).select("problem_id", "trajectory_id", F.col("pos").cast("bigint").alias("pos"), F.col("rank").cast("bigint").alias("rank"))


@query(f"SELECT problem_id, trajectory_id, status, success FROM ({BEST})", "trajectories")
def best_trajectory(s, d):
    return R.best(view(s, d, "trajectories")).select("problem_id", "trajectory_id", "status", "success")


@query(f"SELECT problem_id, chosen_id, rejected_id FROM ({PAIRS})", "trajectories")
def pref_pairs(s, d):
    return _weighed(s, d).select("problem_id", "chosen_id", "rejected_id")


@query(WEIGHED, "trajectories")
def pref_weights(s, d):
    return _weighed(s, d)


@query(f"SELECT count(*) FILTER (WHERE chosen_success) AS kept, count(*) FILTER (WHERE NOT chosen_success) AS skipped, CAST(sum(weight_e4) FILTER (WHERE chosen_success) AS BIGINT) AS weight_e4 FROM ({WEIGHED})", "trajectories")
def pref_require_success(s, d):
    ok = F.col("chosen_success")
    return _weighed(s, d).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"), F.sum(F.when(ok, F.col("weight_e4"))).alias("weight_e4"))


@query(f"SELECT rationale, count(*) AS n, CAST(sum(weight_e4) AS BIGINT) AS weight_e4 FROM ({WEIGHED}) GROUP BY rationale", "trajectories")
def rationale_counts(s, d):
    return _weighed(s, d).groupBy("rationale").agg(F.count("*").alias("n"), F.sum("weight_e4").alias("weight_e4"))


@query(f"SELECT {M.best_of_n_sql()} FROM ({BEST})", "trajectories")
def best_metrics(s, d):
    return M.best_of_n(R.best(view(s, d, "trajectories")))


BEST_BY_MODEL = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_no, problem_id ORDER BY CAST(success AS INT) DESC, CAST(objective_match AS INT) DESC, coalesce(teacher_c, 0) DESC, process_c DESC, pos) AS rank FROM trajectories) WHERE rank = 1"


@query(f"SELECT model_no, {M.best_of_n_sql()} FROM ({BEST_BY_MODEL}) GROUP BY model_no", "trajectories")
def compare_metrics(s, d):
    return M.best_of_n(R.best(view(s, d, "trajectories"), "model_no"), "model_no")


@query(f"SELECT model_no, problem_id, trajectory_id, status, objective_c - reference_c AS gap_c FROM ({BEST_BY_MODEL})", "trajectories")
def compare_details(s, d):
    return R.best(view(s, d, "trajectories"), "model_no").select("model_no", "problem_id", "trajectory_id", "status", (F.col("objective_c") - F.col("reference_c")).alias("gap_c"))


@query(f"SELECT max(CASE WHEN model_no = 2 THEN pass_at_1 END) - max(CASE WHEN model_no = 0 THEN pass_at_1 END) AS pass_gain, max(CASE WHEN model_no = 0 THEN mean_abs_objective_gap END) - max(CASE WHEN model_no = 2 THEN mean_abs_objective_gap END) AS gap_drop FROM (SELECT model_no, {M.best_of_n_sql()} FROM ({BEST_BY_MODEL}) GROUP BY model_no)", "trajectories")
def model_delta(s, d):
    one = lambda m, c: F.max(F.when(F.col("model_no") == m, F.col(c)))
    return compare_metrics(s, d).agg((one(2, "pass_at_1") - one(0, "pass_at_1")).alias("pass_gain"), (one(0, "mean_abs_objective_gap") - one(2, "mean_abs_objective_gap")).alias("gap_drop"))


@query("SELECT status, count(*) AS n FROM trajectories GROUP BY status", "trajectories")
def status_counts(s, d):
    return view(s, d, "trajectories").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT problem_id) AS problems, count(*) AS trajectories, count(*) FILTER (WHERE success) AS successes, (SELECT string_agg(concat(status, '=', n), ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM trajectories GROUP BY status)) AS statuses FROM trajectories", "trajectories")
def rollout_summary(s, d):
    """Counts of problems, trajectories, successes and statuses: partial sums a problem and status, then one row."""
    per = view(s, d, "trajectories").groupBy("problem_id", "status").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"))
    one = per.groupBy("problem_id").agg(F.collect_list(F.struct("status", "n", "ok")).alias("of"))  # a handful of statuses
    rows = one.select(F.posexplode("of").alias("k", "x")).select("x.*", (F.col("k") == 0).cast("bigint").alias("problems"))
    by = rows.groupBy("status").agg(*[F.sum(c).alias(c) for c in ("n", "ok", "problems")])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "n"))), lambda x: F.concat(x["status"], F.lit("="), x["n"].cast("string"))), ",")
    return by.agg(F.coalesce(F.sum("problems"), F.lit(0)).alias("problems"), F.sum("n").alias("trajectories"), F.sum("ok").alias("successes"), text.alias("statuses"))


@query("SELECT coalesce(template_name, 'all') AS template_name, coalesce(status, 'all') AS status, count(*) AS n FROM trajectories GROUP BY ROLLUP (template_name, status)", "trajectories")
def status_rollup(s, d):
    return view(s, d, "trajectories").rollup("template_name", "status").agg(F.count("*").alias("n")).select(F.coalesce("template_name", F.lit("all")).alias("template_name"), F.coalesce("status", F.lit("all")).alias("status"), "n")


@query(M.histogram_sql("trajectories", "teacher_c"), "trajectories")
def score_hist(s, d):
    return M.histogram(view(s, d, "trajectories"), "teacher_c")


@query(M.histogram_sql(f"({WEIGHED})", "weight_e4"), "trajectories")
def weight_hist(s, d):
    return M.histogram(_weighed(s, d), "weight_e4")


# ---- evaluation

#: What each kind of result line is, by the case of the fixture.
CLASSIFIED = """SELECT event_id, status NOT IN ('TIMEOUT', 'RUNTIME_ERROR', 'MISSING_RESULT') AS execution_ok, status, CAST(objective_value AS DOUBLE) AS objective_value, NOT coalesce(isnan(objective_value), FALSE) AND coalesce(abs(objective_value - reference_objective) <= 0.0001, FALSE) AS objective_match FROM (
  SELECT event_id, reference_objective, CASE WHEN timed_out THEN 'TIMEOUT' WHEN exit_code <> 0 THEN 'RUNTIME_ERROR' WHEN k = 0 THEN 'MISSING_RESULT' WHEN k IN (3, 6, 15) THEN 'INVALID_RESULT' WHEN k IN (1, 2, 8, 11, 12) THEN 'OPTIMAL' WHEN k IN (4, 14) THEN 'FEASIBLE' WHEN k = 5 THEN '2' WHEN k = 9 THEN '1' WHEN k = 10 THEN '[1]' WHEN k = 13 THEN concat('{', chr(39), 'code', chr(39), ': 1}') ELSE 'UNKNOWN' END AS status,
    CAST(CASE WHEN timed_out OR exit_code <> 0 THEN NULL WHEN k = 1 THEN floor(reference_objective) WHEN k = 2 THEN 3.5 WHEN k = 5 THEN 7.0 WHEN k = 8 THEN 5.0 WHEN k = 10 THEN 2.0 WHEN k = 11 THEN 1.0 WHEN k = 12 THEN 'nan'::DOUBLE WHEN k = 14 THEN 1000.0 END AS DOUBLE) AS objective_value FROM (SELECT *, event_id % 16 AS k FROM executions))"""

PREDICTED = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY pos DESC) AS rn FROM trajectories) WHERE rn = 1"


def _last_predictions(s, d):
    t = view(s, d, "trajectories").select("problem_id", "pos", "execution_ok", "status", "success")
    return t.groupBy("problem_id").agg(F.max_by(F.struct("execution_ok", "status", "success"), "pos").alias("p")).select("problem_id", "p.*")


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE execution_ok) AS executed, count(*) FILTER (WHERE status = 'OPTIMAL') AS optimal, count(*) FILTER (WHERE success) AS successes FROM dataset JOIN ({PREDICTED}) AS p USING (problem_id)", "trajectories", "dataset")
def eval_predictions(s, d):
    got = view(s, d, "dataset").select("problem_id").join(_last_predictions(s, d), "problem_id")
    return got.agg(F.count("*").alias("total"), F.count_if("execution_ok").alias("executed"), F.count_if(F.col("status") == "OPTIMAL").alias("optimal"), F.count_if("success").alias("successes"))


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE execution_ok) AS executed, count(*) FILTER (WHERE status = 'OPTIMAL') AS optimal, count(*) FILTER (WHERE status = 'OPTIMAL' AND objective_match) AS successes FROM dataset JOIN ({CLASSIFIED}) AS e ON problem_id = event_id", "dataset", "executions")
def eval_self(s, d):
    """Without predictions the dataset's own answers are scored, by what running them gave."""
    ran = V.classify(view(s, d, "executions")).select(F.col("event_id").alias("problem_id"), "execution_ok", "status", "success")
    got = view(s, d, "dataset").select("problem_id").join(ran, "problem_id")
    return got.agg(F.count("*").alias("total"), F.count_if("execution_ok").alias("executed"), F.count_if(F.col("status") == "OPTIMAL").alias("optimal"), F.count_if("success").alias("successes"))


@query("SELECT problem_id, template_name FROM dataset WHERE problem_id NOT IN (SELECT problem_id FROM trajectories)", "trajectories", "dataset")
def missing_predictions(s, d):
    return view(s, d, "dataset").join(view(s, d, "trajectories").select("problem_id"), "problem_id", "left_anti").select("problem_id", "template_name")


# ---- factory


@query("SELECT seed, variant, traj, concat(template_name, '-seed', lpad(CAST(seed AS VARCHAR), CAST(greatest(4, length(CAST(seed AS VARCHAR))) AS INT), '0'), '-q', lpad(CAST(variant AS VARCHAR), 2, '0'), '-t', lpad(CAST(traj AS VARCHAR), 2, '0')) AS attempt_id FROM attempts", "attempts")
def gen_grid(s, d):
    return view(s, d, "attempts").select("seed", "variant", "traj", F.format_string("%s-seed%04d-q%02d-t%02d", "template_name", "seed", "variant", "traj").alias("attempt_id"))


@query("SELECT attempt_key, template_name FROM attempts WHERE success", "attempts")
def accept_verified(s, d):
    return view(s, d, "attempts").where("success").select("attempt_key", "template_name")


@query("SELECT attempt_key, accepted FROM (SELECT *, CAST(sum(CAST(success AS INT)) OVER (ORDER BY seed, variant, traj) AS BIGINT) AS accepted FROM attempts) WHERE accepted < 120 OR (accepted = 120 AND success)", "attempts")
def accept_until_target(s, d):
    return S.until_target(view(s, d, "attempts"), 120).select("attempt_key", "accepted")


@query("SELECT template_name, count(*) AS n FROM attempts WHERE success GROUP BY template_name", "attempts")
def template_dist(s, d):
    return view(s, d, "attempts").where("success").groupBy("template_name").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT seed) AS seeds, count(DISTINCT seed * 2 + variant) AS variants, count(*) AS attempted, count(*) FILTER (WHERE success) AS accepted, CASE WHEN count(*) = 0 THEN 0.0 ELSE CAST(count(*) FILTER (WHERE success) AS DOUBLE) / count(*) END AS verification_rate FROM attempts", "attempts")
def gen_summary(s, d):
    per = view(s, d, "attempts").groupBy("seed").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"), F.size(F.collect_set("variant")).alias("variants"))
    return per.agg(F.count("*").alias("seeds"), F.sum("variants").alias("variants"), F.sum("n").alias("attempted"), F.sum("ok").alias("accepted"), M.ratio(F.sum("ok"), F.sum("n")).alias("verification_rate"))


GROUP_SPLIT = """SELECT grp, CASE WHEN place <= total * 80 // 100 THEN 'train' WHEN place <= total * 80 // 100 + total * 10 // 100 THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT grp, row_number() OVER (ORDER BY (grp * 1103515245 + 12345) % 2147483648, grp) AS place, count(*) OVER () AS total FROM (SELECT DISTINCT seed * 2 + variant AS grp FROM attempts))"""


def _groups(s, d):
    return S.by_group(view(s, d, "attempts").select((F.col("seed") * 2 + F.col("variant")).alias("grp")).distinct(), "grp", [("train", 80), ("valid", 10), ("test", 10)])


@query(GROUP_SPLIT, "attempts")
def group_split(s, d):
    return _groups(s, d).select("grp", "split")


@query(f"SELECT split, count(*) AS n FROM ({GROUP_SPLIT}) GROUP BY split", "attempts")
def split_sizes(s, d):
    names = s.createDataFrame([("train",), ("valid",), ("test",)], "split string")
    return names.join(_groups(s, d).groupBy("split").agg(F.count("*").alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))


DRAW = "(c_custkey * 1103515245 + 12345) % 2147483648 % 100"


@query(f"SELECT template_name, count(*) AS n FROM (SELECT CASE WHEN {DRAW} < 10 THEN 'resource_allocation' WHEN {DRAW} < 25 THEN 'production_planning' WHEN {DRAW} < 60 THEN 'assignment' WHEN {DRAW} < 80 THEN 'tsp' ELSE 'knapsack' END AS template_name FROM customer) GROUP BY template_name")
def weighted_choice(s, d):
    x = S.shuffle_key(F.col("c_custkey")) % 100
    name = F.when(x < 10, "resource_allocation").when(x < 25, "production_planning").when(x < 60, "assignment").when(x < 80, "tsp").otherwise("knapsack")
    return table(s, d, "customer").select(name.alias("template_name")).groupBy("template_name").agg(F.count("*").alias("n"))


@query("SELECT seed, n, i, CASE WHEN n = 1 THEN 30 ELSE CAST(round((0.25 + i * 0.55 / (n - 1)) * 100 + 1e-9) AS INT) END AS temperature_c FROM (SELECT seed, n, CAST(unnest(range(n)) AS INT) AS i FROM (SELECT seed, CAST(count(*) AS INT) AS n FROM attempts GROUP BY seed))", "attempts")
def temperature_schedule(s, d):
    """The temperatures of each seed's attempts, by how many it has, between the bounds of a stage's config."""
    stage = config.Factory("", 0, {}, {})
    counts = view(s, d, "attempts").groupBy("seed").agg(F.count("*").cast("int").alias("n"))
    heat = decoding_ops.schedule(F.col("n"), stage.trajectory_temperature_min, stage.trajectory_temperature_max)
    return counts.select("seed", "n", F.posexplode(heat).alias("i", "t")).select("seed", "n", "i", F.rint(F.col("t") * 100).cast("int").alias("temperature_c"))


@query("SELECT doc_id, substr(response, 1, 1200) AS preview, CAST(length(response) AS BIGINT) AS n_chars FROM responses", "responses")
def trace_rows(s, d):
    return view(s, d, "responses").select("doc_id", F.substring("response", 1, 1200).alias("preview"), F.length("response").cast("bigint").alias("n_chars"))


@query("SELECT o_orderkey, array_to_string(list_slice(v, 1, 2), '|') AS variants FROM (SELECT o_orderkey, CASE WHEN a = b THEN [a] ELSE [a, b] END AS v FROM (SELECT o_orderkey, trim(o_orderpriority) AS a, trim(concat(' ', o_orderstatus, ' ')) AS b FROM orders))")
def variant_dedupe(s, d):
    raw = F.array("o_orderpriority", F.lit("  "), F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")), "o_orderpriority")
    kept = F.array_distinct(F.filter(F.transform(raw, X.strip), lambda x: x != ""))
    return table(s, d, "orders").select("o_orderkey", F.array_join(F.slice(kept, 1, 2), "|").alias("variants"))


@query("SELECT model_no, problem_id, sample FROM (SELECT unnest([0, 1, 2]) AS model_no), (SELECT problem_id FROM dataset ORDER BY problem_id LIMIT 50), (SELECT unnest([1, 2, 3]) AS sample)", "dataset")
def compare_grid(s, d):
    questions = view(s, d, "dataset").select("problem_id").orderBy("problem_id").limit(50)  # the benchmark's size is a feature
    return questions.select(F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("model_no"), "problem_id").select("model_no", "problem_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("sample"))


# ---- datasets


@query("SELECT problem_id, split, concat('system: You solve optimisation problems.\n', 'user: ', question, '\n', 'assistant: ', response) AS chat FROM dataset", "dataset")
def sft_messages(s, d):
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.array(message("system", F.lit("You solve optimisation problems.")), message("user", F.col("question")), message("assistant", F.col("response")))
    return view(s, d, "dataset").select("problem_id", "split", F.array_join(F.transform(messages, lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n").alias("chat"))


@query("SELECT split, count(*) AS n FROM dataset GROUP BY split", "dataset")
def sft_counts(s, d):
    return view(s, d, "dataset").groupBy("split").agg(F.count("*").alias("n"))


_QUOTED = lambda text: "'" + text.replace("'", "''") + "'"
_HINT = "CASE template_name " + " ".join(f"WHEN '{t}' THEN {_QUOTED(h)}" for t, h in prompts.HINTS.items()) + f" ELSE {_QUOTED(prompts.OTHER)} END"
_ASKED = f"concat('Family: ', template_name, '\nHint: ', {_HINT}, '\n\nQuestion:\n', question)"


@query(f"SELECT w.problem_id, concat('system=', {_QUOTED(prompts.ANSWER)}, '\nuser=', {_ASKED.replace('template_name', 'dataset.template_name')}) AS prompt, chosen_id AS chosen, rejected_id AS rejected, weight_e4, rationale FROM ({WEIGHED}) AS w JOIN dataset USING (problem_id)", "trajectories", "dataset")
def dpo_rows(s, d):
    """Pairs with their prompts, which are written after the join: Spark's estimate takes a made text for 20 bytes, and would broadcast them."""
    questions = view(s, d, "dataset").select("problem_id", "question", "template_name").hint("merge")
    asked = prompts.messages(F.col("question"), F.col("template_name"))
    prompt = F.array_join(F.transform(asked, lambda m: F.concat_ws("=", m["role"], m["content"])), "\n")
    return _weighed(s, d).drop("template_name").join(questions, "problem_id").select("problem_id", prompt.alias("prompt"), F.col("chosen_id").alias("chosen"), F.col("rejected_id").alias("rejected"), "weight_e4", "rationale")


@query(f"SELECT split, count(*) AS n, CAST(sum(problem_id) AS BIGINT) AS ids FROM (SELECT problem_id, CASE WHEN row_number() OVER (ORDER BY problem_id) <= greatest(1, count(*) OVER () * 9 // 10) THEN 'train' ELSE 'valid' END AS split FROM ({PAIRS})) GROUP BY split", "trajectories")
def dpo_split(s, d):
    return S.train_valid(R.pairs(view(s, d, "trajectories")).select("problem_id"), "problem_id").groupBy("split").agg(F.count("*").alias("n"), F.sum("problem_id").alias("ids"))


@query("SELECT conv_id, string_agg(concat('<', role, '> ', text), '\n' ORDER BY turn, role, text) AS chat FROM conversations GROUP BY conv_id")
def chat_text(s, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return table(s, d, "conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(F.lit("<"), x["role"], F.lit("> "), x["text"])), "\n").alias("chat"))


@query(f"SELECT problem_id, concat({_QUOTED(prompts.ANSWER)}, '\n\n', {_ASKED}) AS prompt FROM dataset", "dataset")
def prompt_build(s, d):
    return view(s, d, "dataset").select("problem_id", prompts.answer(F.col("question"), F.col("template_name")).alias("prompt"))


# ---- text


@query("SELECT doc_id, trim(CASE WHEN doc_id % 5 = 0 OR doc_id % 5 = 4 THEN response WHEN doc_id % 5 = 3 THEN regexp_replace(response, '(?is)^.*```PYTHON\\s*', '') ELSE regexp_extract(response, '(?is)^.*```(?:python|py)?\\s*(.*?)```', 1) END, ' \t\n\r\v\f') AS code FROM responses".replace("\\v", chr(11)).replace("\\f", chr(12)), "responses")
def extract_code(s, d):
    return view(s, d, "responses").select("doc_id", X.extract_code(F.col("response")).alias("code"))


@query("SELECT doc_id, CAST(length(regexp_replace(response, '[^(\\[{]', '', 'g')) - length(regexp_replace(response, '[^)\\]}]', '', 'g')) AS INT) AS balance FROM responses", "responses")
def delim_balance(s, d):
    return view(s, d, "responses").select("doc_id", X.delimiter_balance(F.col("response")).alias("balance"))


_START = lambda p: f"CASE WHEN regexp_matches(response, '{p}') THEN strpos(response, regexp_extract(response, '{p}')) - 1 END"


@query(f"SELECT doc_id, CAST(least({', '.join(_START(p.replace('.+$', '[^' + chr(10) + chr(13) + ']')) for p in X.CODE_STARTS)}) AS BIGINT) AS start FROM (SELECT doc_id, concat(chr(10), response) AS response FROM responses)".replace("(?m)^", "\\n"), "responses")
def code_start(s, d):
    """Offset of the first line of code in every response."""
    return view(s, d, "responses").select("doc_id", X.code_start(F.col("response")).cast("bigint").alias("start"))


HITS = " + ".join(f"CAST(contains(response, '{t}') AS INT)" for t in X.STEP_TITLES)


@query(f"SELECT doc_id, CAST(least(10000, ({HITS}) * 375 + CASE WHEN doc_id % 2 = 0 THEN 3500 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 3500 ELSE 0 END) AS INT) AS score_e4 FROM responses", "responses")
def process_score(s, d):
    return view(s, d, "responses").select("doc_id", X.process_score_e4(F.col("response"), F.expr("doc_id % 2 = 0"), F.expr("doc_id % 3 = 0")).cast("int").alias("score_e4"))


@query("SELECT event_id, props AS stripped FROM events")
def strip_json_fences(s, d):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return table(s, d, "events").select("event_id", X.strip_json_fences(fenced).alias("stripped"))


@query(f"SELECT event_id, execution_ok, status, CASE WHEN isnan(objective_value) THEN NULL ELSE objective_value END AS objective_value, coalesce(isnan(objective_value), FALSE) AS no_number, objective_match FROM ({CLASSIFIED})", "executions")
def verify_classify(s, d):
    value = F.col("objective_value")
    return V.classify(view(s, d, "executions")).select("event_id", "execution_ok", "status", F.when(~F.isnan(value), value).alias("objective_value"), F.coalesce(F.isnan(value), F.lit(False)).alias("no_number"), "objective_match")


# ---- optima


@query("""SELECT problem_id, CAST(max(v) AS BIGINT) AS optimum FROM (SELECT problem_id, m, sum(CASE WHEN (m >> CAST(pos - 1 AS INT)) & 1 = 1 THEN value ELSE 0 END) AS v, sum(CASE WHEN (m >> CAST(pos - 1 AS INT)) & 1 = 1 THEN weight ELSE 0 END) AS w, max(capacity) AS c
  FROM knap_items, (SELECT CAST(unnest(generate_series(0, 63)) AS INT) AS m) GROUP BY problem_id, m) WHERE w <= c GROUP BY problem_id""", "knap_items")
def opt_knapsack(s, d):
    return O.knapsack(view(s, d, "knap_items")).select("problem_id", "optimum")


COST = "8 + (p_partkey * 7 + w * 13 + t * 17 + w * t * 5) % 21"


@query(f"""WITH c AS (SELECT p_partkey AS problem_id, w, t, {COST} AS cost FROM part, (SELECT unnest([0, 1, 2, 3]) AS w), (SELECT unnest([0, 1, 2, 3]) AS t))
  SELECT a.problem_id, CAST(min(a.cost + b.cost + e.cost + f.cost) AS BIGINT) AS optimum FROM c AS a JOIN c AS b USING (problem_id) JOIN c AS e USING (problem_id) JOIN c AS f USING (problem_id)
  WHERE a.w = 0 AND b.w = 1 AND e.w = 2 AND f.w = 3 AND a.t <> b.t AND a.t <> e.t AND a.t <> f.t AND b.t <> e.t AND b.t <> f.t AND e.t <> f.t GROUP BY a.problem_id""")
def opt_assignment(s, d):
    four = F.array(*[F.lit(i) for i in range(4)])
    grid = table(s, d, "part").select("p_partkey", F.explode(four).alias("w")).select("p_partkey", "w", F.explode(four).alias("t"))
    return O.assignment(grid.select(F.col("p_partkey").alias("problem_id"), "w", "t", F.expr(COST).alias("cost"))).select("problem_id", "optimum")


@query("""WITH RECURSIVE n AS (SELECT n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS c, n_nationkey AS k FROM nation),
  arc AS (SELECT a.r, a.c AS i, b.c AS j, 12 + (least(a.k, b.k) * 31 + greatest(a.k, b.k) * 17) % 49 AS dist FROM n AS a JOIN n AS b ON a.r = b.r AND a.c <> b.c),
  path AS (SELECT r, i, j AS at, dist, (1 << CAST(i AS INT)) | (1 << CAST(j AS INT)) AS seen FROM arc WHERE i = 0 UNION ALL SELECT path.r, path.i, arc.j, path.dist + arc.dist, seen | (1 << CAST(arc.j AS INT)) FROM path JOIN arc ON arc.r = path.r AND arc.i = path.at WHERE seen & (1 << CAST(arc.j AS INT)) = 0)
  SELECT path.r AS problem_id, CAST(min(path.dist + arc.dist) AS BIGINT) AS optimum FROM path JOIN arc ON arc.r = path.r AND arc.i = path.at AND arc.j = 0 WHERE seen = 31 GROUP BY path.r""")
def opt_tsp(s, d):
    n = table(s, d, "nation").select(F.col("n_regionkey").alias("problem_id"), (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).alias("c"), F.col("n_nationkey").alias("k"))
    b = n.select("problem_id", F.col("c").alias("j"), F.col("k").alias("k2"))
    return O.tour(n.join(b, "problem_id").where("c <> j").select("problem_id", F.col("c").alias("i"), "j", F.expr("12 + (least(k, k2) * 31 + greatest(k, k2) * 17) % 49").alias("dist"))).select("problem_id", "optimum")


# ---- training history and losses


POINTS = "SELECT * FROM log_history WHERE loss_c IS NOT NULL AND step IS NOT NULL"


@query(f"""SELECT run_id, num_log_points, first_step, last_step, first_loss_c, last_loss_c, best_loss_c, last_loss_c - first_loss_c AS loss_delta_c, first_loss_c - last_loss_c AS loss_reduction_c, CASE WHEN first_loss_c = 0 THEN 0.0 ELSE CAST(first_loss_c - last_loss_c AS DOUBLE) / CAST(first_loss_c AS DOUBLE) END AS relative_loss_reduction, final_epoch_c, final_lr_e9
  FROM (SELECT run_id, count(*) AS num_log_points, arg_min(step, pos) AS first_step, arg_max(step, pos) AS last_step, arg_min(loss_c, pos) AS first_loss_c, arg_max(loss_c, pos) AS last_loss_c, min(loss_c) AS best_loss_c, arg_max(coalesce(epoch_c, 0), pos) AS final_epoch_c, arg_max(coalesce(lr_e9, 0), pos) AS final_lr_e9 FROM ({POINTS}) GROUP BY run_id)""", "log_history")
def loss_summary(s, d):
    return H.summary(view(s, d, "log_history"), "run_id")


_METRICS = " UNION ALL ".join(f"SELECT run_id, pos, '{m}' AS metric, {m}_c AS v FROM ({POINTS}) WHERE {m}_c IS NOT NULL" for m in H.METRICS)
_HIGH = ", ".join(f"'{m}'" for m, best in H.METRICS.items() if best == "max")


@query(f"SELECT run_id, metric, arg_min(v, pos) AS first_value, arg_max(v, pos) AS last_value, CASE WHEN metric IN ({_HIGH}) THEN max(v) ELSE min(v) END AS best_value FROM ({_METRICS}) GROUP BY run_id, metric", "log_history")
def metric_first_last_best(s, d):
    return H.first_last_best(view(s, d, "log_history"), "run_id")


@query("""SELECT run_id, max(pos) AS pos, count(*) AS n, CAST(sum(margin) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS reward_margin, CAST(sum(hit) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS preference_accuracy
  FROM (SELECT run_id, pos, entropy_c - 40 AS margin, CAST(entropy_c > 50 AS INT) AS hit, logged, sum(CAST(logged AS INT)) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CAST(logged AS INT) AS part FROM log_history) GROUP BY run_id, part HAVING bool_or(logged)""", "log_history")
def log_interval_avg(s, d):
    """Means of what the steps since the last log point gave, at each log point."""
    steps = view(s, d, "log_history").select("run_id", "pos", (F.col("entropy_c") - 40).alias("reward_margin"), (F.col("entropy_c") > 50).cast("int").alias("preference_accuracy"), "logged")
    return H.interval_means(steps, "run_id", "logged", ["reward_margin", "preference_accuracy"])


_SHOWN = "CASE WHEN bool_or(mean_token_accuracy_c IS NOT NULL) OVER w THEN coalesce(mean_token_accuracy_c, 0) WHEN bool_or(reward_margin_c IS NOT NULL) OVER w THEN coalesce(reward_margin_c, 0) WHEN bool_or(preference_accuracy_c IS NOT NULL) OVER w THEN coalesce(preference_accuracy_c, 0) ELSE coalesce(grad_norm_c, 0) END"


@query(f"SELECT run_id, step, loss_c, coalesce(lr_e9, 0) AS lr_e9, {_SHOWN} AS shown, CASE WHEN bool_or(mean_token_accuracy_c IS NOT NULL) OVER w THEN 'mean_token_accuracy' WHEN bool_or(reward_margin_c IS NOT NULL) OVER w THEN 'reward_margin' WHEN bool_or(preference_accuracy_c IS NOT NULL) OVER w THEN 'preference_accuracy' ELSE 'grad_norm' END AS metric FROM ({POINTS}) WINDOW w AS (PARTITION BY run_id)", "log_history")
def training_series(s, d):
    return H.series(view(s, d, "log_history"), "run_id")


@query("SELECT vec_id, CAST(list_sum(list_transform(embedding[8:63], lambda x: CAST(floor(CAST(x AS DOUBLE) * -1000000) AS BIGINT))) AS DOUBLE) / 56 AS logp_e6 FROM embeddings")
def seq_logps(s, d):
    """Mean log-probability of a sequence's labels in millionths; the first eight labels are the prompt's, and a place's probability is that of the next label."""
    labels = F.transform("embedding", lambda x, i: F.when(i < 8, F.lit(T.IGNORED)).otherwise(F.lit(1)))
    logps = F.transform("embedding", lambda x: F.floor(x.cast("double") * -1000000).cast("double"))
    return table(s, d, "embeddings").select("vec_id", T.sequence_logp(logps, labels).alias("logp_e6"))


# ---- documents

_MARKS = ["## ", "### ", "#### ", "> ", "- ", "1. ", "# ", "", ""]
_MARK = "CASE (doc_id + line_no) % 9 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(_MARKS)) + " END"
LINES = "SELECT doc_id, CAST(i - 1 AS INT) AS line_no, ls[i] AS line FROM (SELECT doc_id, string_split(text, '\n') AS ls, unnest(generate_series(1, len(string_split(text, '\n')))) AS i FROM documents)"
PREFIXED = f"SELECT doc_id, line_no, trim(concat({_MARK}, line), ' \t\n\r\x0b\x0c') AS line FROM ({LINES})"
KIND = "CASE WHEN line = '' OR starts_with(line, '# ') THEN NULL WHEN starts_with(line, '## ') THEN 'heading1' WHEN starts_with(line, '### ') THEN 'heading2' WHEN starts_with(line, '#### ') THEN 'heading3' WHEN starts_with(line, '> ') THEN 'quote' WHEN starts_with(line, '- ') THEN 'bullet' WHEN starts_with(line, '1. ') THEN 'ordered' ELSE 'text' END"
NODES = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS node_no, kind, trim(regexp_replace(line, '^(## |### |#### |> |- |1\\.\\s+)', ''), ' \t\r\x0b\x0c') AS content FROM (SELECT *, {KIND} AS kind FROM ({PREFIXED})) WHERE kind IS NOT NULL"


def _nodes(s, d):
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.element_at(F.array(*[F.lit(m) for m in _MARKS]), ((F.col("doc_id") + i) % 9 + 1).cast("int")), x))
    return table(s, d, "documents").select("doc_id", F.posexplode(D.markdown_nodes(F.array_join(marked, "\n"))).alias("node_no", "node"))


@query(f"SELECT doc_id, node_no, kind FROM ({NODES})")
def md_nodes(s, d):
    return _nodes(s, d).select("doc_id", F.col("node_no").cast("bigint").alias("node_no"), F.col("node.kind").alias("kind"))


_BLOCK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in D.BLOCK_TYPES.items()) + " END"


@query(f"SELECT doc_id, node_no // 10 AS chunk, count(*) AS n, CAST(sum({_BLOCK}) AS BIGINT) AS types, string_agg(content, '\n' ORDER BY node_no) AS content FROM ({NODES}) GROUP BY doc_id, node_no // 10")
def md_chunks(s, d):
    """Blocks in the requests of ten that publish a document."""
    chunks = D.chunks(_nodes(s, d).select("doc_id", "node_no", D.block(F.col("node")).alias("block")))
    kinds = F.aggregate("blocks", F.lit(0).cast("bigint"), lambda a, x: a + x["block_type"])
    return chunks.select("doc_id", "chunk", F.size("blocks").cast("bigint").alias("n"), kinds.alias("types"), F.array_join(F.transform("blocks", lambda x: x["elements"][0]["text_run"]["content"]), "\n").alias("content"))


@query(f"SELECT {_BLOCK} AS block_type, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM ({NODES}) GROUP BY kind")
def md_blocks(s, d):
    block = _nodes(s, d).select(D.block(F.col("node")).alias("b"))
    return block.groupBy(F.col("b.block_type").alias("block_type")).agg(F.count("*").alias("n"), F.sum(F.length(F.col("b.elements")[0]["text_run"]["content"])).alias("chars"))


@query("SELECT user_id, event_type, arg_max(event_id, ROW(ts, event_id)) AS latest FROM events GROUP BY user_id, event_type")
def latest_run(s, d):
    """The latest of each user's runs of a kind, as `files.latest` picks among files: by time, then by name."""
    return table(s, d, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "event_type", F.col("m.event_id").alias("latest"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def run_stamp(s, d):
    return table(s, d, "events").select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"))


from .plans import decoding, named, report  # noqa: E402, F401 - they reuse SQL of the queries above
