"""The stages that ask models: a verified dataset, rollouts, and the evaluation and comparison of models. A stage asks a provider,
runs the answers' code and classifies what came out. What models answered and what code printed is written once and read again,
so a lost executor does not ask twice for rows that are already used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, prompts, records
from .functions.python_values import py_round
from .functions.repair import answer_code
from .functions.text import process_score_e4, strip, strip_json_fences
from .operators import execution
from .operators import templates
from .operators import ranking as R
from .operators import splits as S
from .operators.verify import TOLERANCE, classify
from .sources import jsonl
from .sources.providers import Provider

#: (key, code, ...) to the same rows with exit_code, timed_out, stdout, stderr.
Runner = Callable[[DataFrame], DataFrame]


def runner(allow: bool, timeout: float = 20.0) -> Runner:
    """Runs code in subprocesses of the workers, if that is allowed."""
    return lambda df: execution.run(df, timeout=timeout, allow=allow)


def replayed(executions: DataFrame, key: str) -> Runner:
    """Executions recorded before, as a table (key, exit_code, timed_out, stdout, stderr). Code without a record counts as failed."""

    def run(df: DataFrame) -> DataFrame:
        got = df.join(executions.select(key, "exit_code", "timed_out", "stdout", "stderr"), key, "left")
        return got.withColumns({"exit_code": F.coalesce("exit_code", F.lit(-1)), "timed_out": F.coalesce("timed_out", F.lit(False)), "stdout": F.coalesce("stdout", F.lit("")), "stderr": F.coalesce("stderr", F.lit("no record"))})

    return run


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = jsonl.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def verified(df: DataFrame, run: Runner) -> DataFrame:
    """df (response, reference_objective, ...) with code and the struct verification; the code is run once."""
    got = classify(run(df.withColumn("code", F.coalesce(answer_code(F.col("response")), F.lit("")))))
    reason = F.when(F.col("success"), None).when(F.col("timed_out"), "time is up").when(F.col("exit_code") != 0, F.coalesce(F.nullif(strip(F.col("stderr")), F.lit("")), F.lit("the code failed")))
    reason = reason.when(F.col("status") == "MISSING_RESULT", "no result line").when(F.col("status") == "INVALID_RESULT", "the result is no object").when(F.col("status") != "OPTIMAL", F.concat(F.lit("status "), "status")).otherwise("another objective")
    fields = {"success": "success", "execution_ok": "execution_ok", "status": "status", "objective_value": "objective_value", "objective_match": "objective_match", "tolerance": F.lit(TOLERANCE), "stdout": "stdout", "stderr": "stderr", "error_message": reason}
    return got.select(*df.columns, "code", F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]).alias("verification"))


# ---- dataset


def seed_problems(spark: SparkSession, seed: int, n: int, weights: dict[str, int]) -> DataFrame:
    """at (0 to n - 1), template_name, canonical question, instance, reference_solution; the exact optima are found once."""
    made = templates.problems(spark.range(seed, seed + n).withColumnRenamed("id", "seed"), weights)
    return kept(made.select((F.col("seed") - seed).alias("at"), "template_name", F.col("question").alias("canonical"), "instance", "reference_solution"), "seeds")


def variants(problems: DataFrame, rewriter: Provider | None, wanted: int, canonical: bool, styles: list[str], strict: bool = False) -> tuple[DataFrame, int]:
    """One row a wording: problems with variant (from 0) and question; and the number of calls that failed. The canonical question comes
    first if it is wanted, then the rewriter's texts, trimmed, in their order, each once. No wording, a failed call or an answer
    that is no object give the canonical question alone; with strict, a failed call is an error."""
    asked = max(0, wanted - int(canonical))
    own = F.array("canonical")
    if rewriter is None or asked == 0:
        return problems.withColumns({"variant": F.lit(0), "question": F.col("canonical")}), 0
    prompt = problems.select("at", prompts.reword(F.col("canonical"), F.col("template_name"), F.col("instance"), asked, styles).alias("prompt"))
    said = rewriter.answers(prompt, "at", "prompt").where("sample = 1").select("at", "answer", "error")
    texts = F.expr("try_variant_get(try_parse_json(_text), '$.variants', 'array<variant>')")
    said = said.withColumn("_text", strip_json_fences(F.col("answer"))).withColumn("_texts", texts)
    whole = F.startswith(F.schema_of_variant(F.try_parse_json("_text")), F.lit("OBJECT"))
    only_text = F.filter("_texts", lambda v: F.schema_of_variant(v) == "STRING")
    said = kept(said.select("at", (F.col("error").isNotNull() | ~F.coalesce(whole, F.lit(False))).alias("failed"), F.coalesce(F.transform(only_text, lambda v: strip(F.try_variant_get(v, "$", "string"))), F.expr("CAST(array() AS array<string>)")).alias("texts")), "wordings")
    failed = said.where("failed").count()
    if strict and failed:
        raise RuntimeError(f"{failed} questions could not be reworded")
    fresh = F.filter(F.coalesce("texts", F.expr("CAST(array() AS array<string>)")), lambda t: t != "")
    every = F.slice(F.array_distinct(F.concat(own, fresh) if canonical else fresh), 1, wanted)
    every = F.when(F.coalesce("failed", F.lit(True)) | (F.size(every) == 0), own).otherwise(every)
    return problems.join(said, "at", "left").select(*problems.columns, F.posexplode(every).alias("variant", "question")), failed


SUMMARY = "target_verified_samples long, accepted_samples long, verification_rate double, seed_problem_count long, question_variant_count long, attempted_trajectories long, api_request_errors long, trajectories_per_variant long, question_variants_per_seed long, template_distribution map<string, long>, splits map<string, long>"


def generate_dataset(spark: SparkSession, c: config.Factory, teacher: Provider, run: Runner, rewriter: Provider | None = None) -> DataFrame:
    """Asks for answers to generated questions and keeps those whose code finds the optimum, until the target is reached. Writes the
    records by split, the trace of all attempts up to the last one needed, and the summary (also returned: one row).
    teacher answers a question once for each of `c.temperatures()`; a failed call drops the answers of its question."""
    problems = seed_problems(spark, c.seed, c.seeds(), c.template_weights)
    heat = F.array(*[F.lit(float(t)) for t in c.temperatures()])

    def attempt(problems: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """The wordings of some problems, what came of their answers, and how many calls failed."""
        worded, failed = variants(problems, rewriter, c.question_variants_per_seed, c.include_canonical_question, c.question_rewrite_styles)
        worded = worded.withColumn("group_id", F.format_string("%s-seed%04d-q%02d", "template_name", "at", "variant"))
        said = kept(teacher.answers(worded.select("group_id", prompts.answer(F.col("question"), F.col("template_name")).alias("prompt")), "group_id", "prompt"), "answers")
        broken = said.where("error IS NOT NULL").select("group_id").distinct()
        texts = said.join(broken, "group_id", "left_anti").where(strip(F.col("answer")) != "")
        rows = worded.join(texts.select("group_id", (F.col("sample") - 1).alias("traj"), strip(F.col("answer")).alias("response")), "group_id")
        rows = rows.withColumns({"seed": F.col("at"), "attempt_id": F.format_string("%s-t%02d", "group_id", "traj"), "reference_objective": F.col("reference_solution.objective_value"), "temperature": F.element_at(heat, F.least(F.col("traj") + 1, F.size(heat)))})
        return worded, kept(verified(rows, run).withColumn("success", F.col("verification.success")), "attempts"), failed + broken.count()

    # Seeds are tried in ranges that grow with what is missing, so that few answers are asked for beyond the target.
    worded = tried = None
    failed = first = 0
    size = missing = max(1, c.target_verified_samples)
    while first < c.seeds() and missing > 0:
        size = max(-(-missing // max(1, c.question_variants_per_seed * len(c.temperatures()))), size // 2 if first else 1, 1)
        more = attempt(problems.where(F.col("at").between(first, first + size - 1)))
        worded, tried = (more[0], more[1]) if worded is None else (worded.unionByName(more[0]), tried.unionByName(more[1]))
        failed, first, missing = failed + more[2], first + size, missing - more[1].where("success").count()
    used = kept(S.until_target(tried, c.target_verified_samples), "used")
    good = used.where("success")

    shares = [(name, round(100 * share)) for name, share in c.splits.items()]
    groups = S.by_group(good.groupBy("group_id").agg(F.min(F.col("at") * 1024 + F.col("variant")).alias("n")), "n", shares).select("group_id", "split")
    notes = F.struct(F.col("at").alias("seed_problem_index"), F.col("variant").alias("question_variant_index"), "temperature", F.col("canonical").alias("canonical_question"))
    records_ = kept(good.join(groups, "group_id").select(F.col("attempt_id").alias("problem_id"), "split", "template_name", "question", "response", "code", "instance", "reference_solution", "verification", notes.alias("generation_notes")), "records")
    records_.withColumn("_split", F.col("split")).write.mode("overwrite").partitionBy("_split").option("ignoreNullFields", "false").json(f"{c.output_dir}/dataset")
    jsonl.write(used.select(F.col("at").alias("seed_problem_index"), F.col("variant").alias("question_variant_index"), F.col("traj").alias("trajectory_index"), "template_name", "question", F.substring("response", 1, 1200).alias("response_preview"), F.substring("code", 1, 1200).alias("code_preview"), "verification"), f"{c.output_dir}/generation_trace", ["seed_problem_index", "question_variant_index", "trajectory_index"])

    # The rest is a handful of numbers: one row a template or split, and the attempt that reached the target, if one did.
    tried_n, accepted, last = used.agg(F.count("*"), F.count_if("success"), F.max(F.when(F.col("success") & (F.col("accepted") >= c.target_verified_samples), F.struct("at", "variant")))).first()
    reached = worded if last is None else worded.where((F.col("at") < last.at) | ((F.col("at") == last.at) & (F.col("variant") <= last.variant)))
    seeds_n, worded_n = reached.agg(F.countDistinct("at"), F.count("*")).first()
    counted = lambda by: {r[0]: r[1] for r in records_.groupBy(by).count().toLocalIterator()}
    row = (c.target_verified_samples, accepted, round(accepted / tried_n, 4) if tried_n else 0.0, seeds_n, worded_n, tried_n, failed, len(c.temperatures()), c.question_variants_per_seed, counted("template_name"), dict.fromkeys(c.splits, 0) | counted("split"))
    summary = spark.createDataFrame([row], SUMMARY)
    jsonl.write(summary, f"{c.output_dir}/summary")
    return summary


# ---- rollouts


def judged(df: DataFrame, judge: Provider, model: str = "") -> DataFrame:
    """df (trajectory_id, question, response, verification) with teacher_evaluation. A failed call or an answer that is no object scores 0.0 with the verdict bad."""
    asked = df.select("trajectory_id", prompts.judge(F.col("question"), F.col("response"), F.col("verification")).alias("prompt"))
    said = kept(judge.answers(asked, "trajectory_id", "prompt").where("sample = 1").select("trajectory_id", "answer", "error"), "judgements")
    v = F.try_parse_json(strip_json_fences(F.col("answer")))
    whole = F.col("error").isNull() & F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    text = lambda f: F.when(whole, F.try_variant_get(v, f"$.{f}", "string"))
    many = lambda f: F.when(whole, F.try_variant_get(v, f"$.{f}", "array<string>"))
    fields = {
        "overall_score": F.when(whole, text("overall_score")).otherwise("0.0"), "step_score": text("step_score"), "code_score": text("code_score"), "verdict": F.when(whole, text("verdict")).otherwise("bad"),
        "strengths": many("strengths"), "issues": F.when(whole, many("issues")).otherwise(F.array(F.coalesce("error", F.lit("no judgement")))), "rationale": text("rationale"), "model": F.lit(model),
    }
    return df.join(said.withColumn("teacher_evaluation", F.struct(*[x.alias(k) for k, x in fields.items()])).select("trajectory_id", "teacher_evaluation"), "trajectory_id", "left")


def rollouts(problems: DataFrame, policy: Provider, run: Runner, judge: Provider | None = None, source: str = "", judge_model: str = "") -> DataFrame:
    """One row a problem (problem_id, template_name, question, reference_solution) with the array of its trajectories, best first; problems
    must be distinct. Groups are as large as the policy's number of samples. Problems without any answer give no row."""
    asked = problems.select("problem_id", prompts.answer(F.col("question"), F.col("template_name")).alias("prompt"))
    said = kept(policy.answers(asked, "problem_id", "prompt").where("error IS NULL").select("problem_id", (F.col("sample") - 1).alias("sample"), strip(F.coalesce("answer", F.lit(""))).alias("response")), "responses")
    rows = problems.select("problem_id", "template_name", "question", "reference_solution").join(said, "problem_id")
    rows = rows.withColumns({"trajectory_id": F.format_string("%s::sample%d", "problem_id", "sample"), "reference_objective": F.col("reference_solution.objective_value")})
    rows = kept(verified(rows, run), "rollouts")
    score = (process_score_e4(F.col("response"), F.col("verification.execution_ok"), F.col("verification.objective_match")) / 10000).alias("process_score")
    rows = judged(rows, judge, judge_model) if judge is not None else rows.withColumn("teacher_evaluation", F.lit(None).cast(records.JUDGEMENT))
    key = F.struct(*[(-x).alias(f"k{i}") for i, x in enumerate((F.col("verification.success").cast("int"), F.col("verification.objective_match").cast("int"), records.score(F.col("teacher_evaluation.overall_score")), F.col("process_score")))], "sample")
    one = F.struct("trajectory_id", "response", "code", "verification", "process_score", F.lit(source).alias("source"), "teacher_evaluation")
    rows = rows.withColumn("process_score", score)
    got = rows.groupBy("problem_id").agg(F.first("template_name").alias("template_name"), F.first("question").alias("question"), F.first("reference_solution").alias("reference_solution"), F.array_sort(F.collect_list(F.struct(key.alias("key"), one.alias("t")))).alias("all"))
    return got.select("problem_id", "template_name", "question", "reference_solution", F.transform("all", lambda x: x["t"]).alias("trajectories"))


def rollout_summary(rows: DataFrame) -> DataFrame:
    """num_problems, num_trajectories, solver_status_counts: one row, a few statuses."""
    by = {r[0]: r[1] for r in rows.select(F.explode("trajectories.verification.status").alias("status")).groupBy("status").count().toLocalIterator()}
    return rows.sparkSession.createDataFrame([(rows.count(), sum(by.values()), by)], "num_problems long, num_trajectories long, solver_status_counts map<string, long>")


# ---- evaluation


def predictions(rows: DataFrame) -> DataFrame:
    """The best trajectory of each row of rollouts."""
    best = R.best(records.trajectories(rows, "verification", "teacher_evaluation", "source"))
    return best.select("problem_id", "template_name", "question", "response", "code", "verification", "teacher_evaluation", F.abs("objective_gap").alias("objective_gap"), "source", "teacher_score")


def metrics(best: DataFrame, *by: str) -> DataFrame:
    """Rates over predictions (by model, say): means count only the rows that have a gap or a score; an empty side gives 0."""
    n, v = F.count("*"), F.col("verification")
    got = best.groupBy(*by).agg(n.alias("num_examples"), *[x.alias(name) for name, x in {
        "execution_rate": F.count_if(v["execution_ok"]), "feasible_rate": F.count_if(v["status"] == "OPTIMAL"), "pass_at_1": F.count_if(v["success"]),
        "mean_abs_objective_gap": F.avg("objective_gap"), "teacher_mean_score": F.avg("teacher_score"), "teacher_var_score": F.var_pop("teacher_score"),
    }.items()])
    share = lambda c: py_round(F.coalesce(F.col(c) / F.nullif("num_examples", F.lit(0)), F.lit(0.0)), 4)
    mean = lambda c, places: py_round(F.coalesce(F.col(c), F.lit(0.0)), places)
    return got.withColumns({"execution_rate": share("execution_rate"), "feasible_rate": share("feasible_rate"), "pass_at_1": share("pass_at_1"), "mean_abs_objective_gap": mean("mean_abs_objective_gap", 4), "teacher_mean_score": mean("teacher_mean_score", 4), "teacher_var_score": mean("teacher_var_score", 6)})


def evaluate_predictions(dataset: DataFrame, given: DataFrame | None, run: Runner) -> tuple[DataFrame, DataFrame]:
    """(metrics, details) of predictions (problem_id, response, code) run again against the dataset's optima; given None: the dataset's own
    answers. Of several predictions for a problem the last one counts, by the columns jsonl.ORDER (without them, the greatest text).
    Problems without a prediction take no part."""
    given = dataset if given is None else given
    order = [c for c in jsonl.ORDER if c in given.columns] or ["response", "code"]
    given = given.groupBy("problem_id").agg(F.max_by(F.struct("response", "code"), F.struct(*order)).alias("p")).select("problem_id", "p.*")
    rows = dataset.select("problem_id", "template_name", F.col("reference_solution.objective_value").alias("reference_objective")).join(given, "problem_id")
    own = rows.where(F.coalesce("code", F.lit("")) != "").select("problem_id", "template_name", "reference_objective", "code")
    made = rows.where(F.coalesce("code", F.lit("")) == "").select("problem_id", "template_name", "reference_objective", F.coalesce(answer_code(F.col("response")), F.lit("")).alias("code"))
    ran = kept(classify(run(own.unionByName(made))), "evaluated")
    details = ran.select("problem_id", "template_name", F.struct("success", "execution_ok", "status", "objective_value", "objective_match", F.lit(TOLERANCE).alias("tolerance"), "stdout", "stderr").alias("verification"))
    best = details.withColumns({"objective_gap": F.lit(None).cast("double"), "teacher_score": F.lit(None).cast("double")})
    return metrics(best).select("num_examples", "execution_rate", "feasible_rate", "pass_at_1"), details


def benchmark_questions(spark: SparkSession, c: config.Compare, weights: dict[str, int], rewriter: Provider | None = None, styles: list[str] | None = None) -> DataFrame:
    """The first `target_questions` wordings, by seed and variant. No wordings wanted gives none; a failed call is an error."""
    seeds = c.target_questions if c.max_seed_problems is None else c.max_seed_problems
    worded, _ = variants(seed_problems(spark, c.seed, seeds, weights), rewriter, c.question_variants_per_seed, c.include_canonical_question, styles or [], strict=True)
    worded = worded.where(F.lit(c.question_variants_per_seed > 0)).orderBy("at", "variant").limit(c.target_questions)
    return kept(worded.select(F.format_string("%s-compare%04d-q%02d", "template_name", "at", "variant").alias("problem_id"), "template_name", "question", "instance", "reference_solution"), "questions")


def compare_models(questions: DataFrame, policies: dict[str, Provider], run: Runner, judge: Provider | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics by model_name, details) of several models on the same questions."""
    every = None
    for name, policy in policies.items():
        one = predictions(rollouts(questions, policy, run, judge, name)).withColumn("model_name", F.lit(name))
        every = one if every is None else every.unionByName(one)
    details = kept(every, "compared")
    return metrics(details, "model_name"), details.drop("teacher_score")
