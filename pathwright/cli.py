"""Command line: python -m pathwright.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, prompts, records, stages
from .operators import ranking as R
from .operators import splits as S
from .operators import templates
from .sources import jsonl
from .sources.providers import Chat, Provider, Replay


def generate_instances(spark: SparkSession, config_path: str) -> DataFrame:
    """Instances, questions and reference optima of a factory's seeds, as JSON lines in its output folder."""
    c = config.stage(config.Factory, config.load(config_path))
    got = templates.problems(spark.range(c.seed, c.seed + c.seeds()).withColumnRenamed("id", "seed"), c.template_weights)
    rows = got.select(F.format_string("%s-seed%04d", "template_name", F.col("seed") - c.seed).alias("problem_id"), "template_name", "question", "instance", "reference_solution")
    jsonl.write(rows, f"{c.output_dir}/instances")
    return rows


def prepare_sft(spark: SparkSession, input_dir: str, output_dir: str) -> DataFrame:
    """Three messages a row, by split; counts by split."""
    rows = jsonl.read(spark, input_dir, records.DATASET, ("problem_id", "split", "question", "response"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    got = rows.select("split", "problem_id", "template_name", F.array(message("system", F.lit("You solve optimisation problems.")), message("user", F.col("question")), message("assistant", F.col("response"))).alias("messages"))
    got.write.mode("overwrite").partitionBy("split").option("ignoreNullFields", "false").json(output_dir)
    return rows.groupBy("split").agg(F.count("*").alias("n"))


def _report(spark: SparkSession, path: str, **row: Any) -> DataFrame:
    """One row, written as JSON."""
    kinds = {int: "long", str: "string", bool: "boolean", dict: "map<string, long>"}
    got = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items()))
    jsonl.write(got, path)
    return got


def build_preferences(spark: SparkSession, rollout_path: str, output_path: str | None = None, run_root: str = "runs", run_prefix: str = "preferences", require_chosen_success: bool = False, timestamped: bool = True, report_dir: str | None = None) -> DataFrame:
    """Best and worst trajectory of each problem, whole, with their weight, in the rollouts' order; without a path of their own they go to
    the run's folder, as the summary does: pairs, rationales, and the problems skipped because their best answer is not right."""
    run_dir = report_dir or (_stamped(run_root, run_prefix) if timestamped else run_root)
    output_path = output_path or f"{run_dir}/preferences"
    problems = jsonl.read_in_order(spark, rollout_path, records.ROLLOUT, ("problem_id", "trajectories"))
    flat = records.trajectories(problems)
    pairs = stages.kept(R.weigh(R.pairs(flat)), "pairs")
    ok = pairs.where("chosen_success") if require_chosen_success else pairs
    chosen = lambda side: F.get(F.filter("trajectories", lambda t: t["trajectory_id"] == F.col(f"{side}_id")), F.lit(0)).alias(side)
    got = ok.select("problem_id", "chosen_id", "rejected_id", "weight_e4", "rationale").join(problems, "problem_id")
    got = got.select("problem_id", "template_name", "question", chosen("chosen"), chosen("rejected"), (F.col("weight_e4") / 10000).alias("weight"), "rationale", *jsonl.ORDER)
    jsonl.write(got.orderBy(*jsonl.ORDER).drop(*jsonl.ORDER), output_path)
    rationales = {r[0]: r[1] for r in ok.groupBy("rationale").count().collect()}  # four at most
    skipped = pairs.where("NOT chosen_success").count() if require_chosen_success else 0
    return _report(spark, f"{run_dir}/summary", num_pairs=sum(rationales.values()), output_path=output_path, run_dir=run_dir, rationales=rationales, require_chosen_success=require_chosen_success, skipped_for_unsuccessful_chosen=skipped)


PREFERENCE = f"problem_id string, template_name string, question string, chosen {records.TRAJECTORY}, rejected {records.TRAJECTORY}, weight double, rationale string"


def prepare_dpo(spark: SparkSession, config_path: str) -> DataFrame:
    """Prompt messages, chosen, rejected, weight by split: the first nine tenths of the preferences' file order are `train`; counts by
    split. The config names `preference_path` and `output_dir`, else `run_root` and `run_prefix` of a folder with the time in its name."""
    c = config.load(config_path)
    output_dir = c.get("output_dir") or _run_dir(c, "dpo_data")
    pairs = jsonl.read_in_order(spark, c["preference_path"], PREFERENCE, ("problem_id", "chosen", "rejected"))
    got = S.train_valid(pairs, *jsonl.ORDER)
    rows = got.select("split", "problem_id", "template_name", prompts.messages(F.col("question"), F.col("template_name")).alias("prompt_messages"), F.col("chosen.response").alias("chosen"), F.col("rejected.response").alias("rejected"), F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("rationale", F.lit("")).alias("rationale"))
    rows.write.mode("overwrite").partitionBy("split").option("ignoreNullFields", "false").json(output_dir)
    by = {r[0]: r[1] for r in got.groupBy("split").count().collect()}  # two at most
    return _report(spark, f"{output_dir.rstrip('/')}_summary", train=by.get("train", 0), valid=by.get("valid", 0), output_dir=output_dir)


def evaluate(spark: SparkSession, rollout_path: str, output_path: str) -> DataFrame:
    """Rates over the best trajectory of each problem."""
    got = stages.metrics(stages.predictions(jsonl.read(spark, rollout_path, records.ROLLOUT, ("problem_id", "trajectories"))))
    jsonl.write(got, output_path)
    return got


def provider(spark: SparkSession, c: dict[str, Any], recorded: str, key: str, model: str = "PATHWRIGHT_MODEL", **chat: Any) -> Provider:
    """The answers that the config records under `recorded` (key, sample, answer), else the endpoint that the environment names."""
    if c.get(recorded):
        return Replay(jsonl.read(spark, c[recorded], f"{key} {'long' if key == 'at' else 'string'}, sample int, answer string", (key, "sample")))
    found = Chat.from_env(model, **chat)
    if found is None:
        raise RuntimeError(f"set {recorded} in the config, or PATHWRIGHT_CHAT_URL and PATHWRIGHT_CHAT_KEY")
    return found


def _run(c: dict[str, Any]) -> stages.Runner:
    return stages.runner(bool(c.get("allow_execution", False)), float(c.get("timeout_seconds", 20)))


def _judge(spark: SparkSession, c: dict[str, Any], default: bool) -> Provider | None:
    return provider(spark, c, "recorded_judgements", "trajectory_id", "PATHWRIGHT_JUDGE", temperature=0.0) if c.get("teacher_evaluation", default) else None


def _policy(spark: SparkSession, c: dict[str, Any]) -> Provider:
    r = config.stage(config.Rollout, c)
    return provider(spark, c, "recorded_answers", "problem_id", samples=r.num_return_sequences, temperature=r.temperature if r.do_sample else 0.0, max_tokens=r.max_new_tokens, top_p=r.top_p if r.do_sample else None, seed=r.seed)


def _stamped(root: str, prefix: str) -> str:
    return f"{root}/{prefix}_{time.strftime('%Y%m%d_%H%M%S')}"


def _run_dir(c: dict[str, Any], prefix: str) -> str:
    return _stamped(c.get("run_root", "runs"), c.get("run_prefix", prefix))


def generate_dataset(spark: SparkSession, config_path: str) -> DataFrame:
    """Verified records of generated questions by split, the trace of attempts, the summary."""
    raw = config.load(config_path)
    c = config.stage(config.Factory, raw)
    limits = {"timeout": c.request_timeout_seconds, "retries": c.request_max_retries, "backoff": c.request_retry_backoff_seconds}
    teacher = provider(spark, raw, "recorded_answers", "group_id", c.data_model_env_var, temperatures=tuple(c.temperatures()), max_tokens=c.trajectory_max_tokens, **limits)
    more = c.question_variants_per_seed > int(c.include_canonical_question)
    rewriter = provider(spark, raw, "recorded_wordings", "at", c.data_model_env_var, temperature=c.question_rewrite_temperature, max_tokens=c.question_rewrite_max_tokens, **limits) if more else None
    return stages.generate_dataset(spark, c, teacher, _run(raw), rewriter)


def _rollouts(spark: SparkSession, c: dict[str, Any], path: str) -> DataFrame:
    problems = jsonl.read(spark, c["dataset_path"], records.DATASET, ("problem_id", "template_name", "question"))
    jsonl.write(stages.rollouts(problems, _policy(spark, c), _run(c), _judge(spark, c, False), str(c.get("model_path", ""))), path)
    return jsonl.read(spark, path, records.ROLLOUT)


def generate_real_rollouts(spark: SparkSession, config_path: str) -> DataFrame:
    """A model's verified trajectories for each problem of a dataset; their summary."""
    c = config.load(config_path)
    run_dir = _run_dir(c, "real_rollouts")
    got = stages.rollout_summary(_rollouts(spark, c, c.get("output_path") or f"{run_dir}/real_rollouts"))
    jsonl.write(got, f"{run_dir}/summary")
    return got


def evaluate_predictions(spark: SparkSession, dataset_path: str, output_path: str, predictions_path: str | None = None, allow_execution: bool = False) -> DataFrame:
    """Rates of predictions whose code is run again; without predictions, of the dataset's own answers."""
    given = None if predictions_path is None else jsonl.read_in_order(spark, predictions_path, "problem_id string, response string, code string", ("problem_id",))
    got, details = stages.evaluate_predictions(jsonl.read_in_order(spark, dataset_path, records.DATASET, ("problem_id",)), given, stages.runner(allow_execution))
    jsonl.write(got, f"{output_path}/metrics")
    jsonl.write(details, f"{output_path}/details")
    return got


def evaluate_model(spark: SparkSession, config_path: str) -> DataFrame:
    """Rollouts of a model, its best predictions, their metrics, and a preview of preferences."""
    c = config.load(config_path)
    run_dir = _run_dir(c, "test_eval")
    best = stages.predictions(_rollouts(spark, c, f"{run_dir}/test_rollouts"))
    jsonl.write(best.drop("teacher_score"), f"{run_dir}/test_predictions")
    got = stages.metrics(best)
    jsonl.write(got, f"{run_dir}/metrics")
    build_preferences(spark, f"{run_dir}/test_rollouts", f"{run_dir}/test_preferences_preview", report_dir=f"{run_dir}/preferences")
    return got


def compare_models(spark: SparkSession, config_path: str) -> DataFrame:
    """Metrics of several models on the same generated questions."""
    c = config.load(config_path)
    bench = c["benchmark"]
    b = config.stage(config.Compare, bench)
    more = b.question_variants_per_seed > int(b.include_canonical_question)
    rewriter = provider(spark, bench, "recorded_wordings", "at", "PATHWRIGHT_DATA_MODEL", temperature=bench.get("question_rewrite_temperature", 0.6), max_tokens=bench.get("question_rewrite_max_tokens", 1200)) if more else None
    questions = stages.benchmark_questions(spark, b, bench["template_weights"], rewriter, bench.get("question_rewrite_styles"))
    rollout = c.get("rollout") or {}
    policies = {m["name"]: _policy(spark, rollout | m) for m in c["models"]}
    got, details = stages.compare_models(questions, policies, _run(rollout | {"allow_execution": c.get("allow_execution", False)}), _judge(spark, c, True))
    run_dir = _run_dir(c, "model_compare")
    jsonl.write(questions, f"{run_dir}/comparison_questions")
    jsonl.write(got, f"{run_dir}/comparison_summary")
    jsonl.write(details, f"{run_dir}/comparison_details")
    return got


COMMANDS = {
    "generate-dataset": (generate_dataset, ["config_path"]),
    "generate-instances": (generate_instances, ["config_path"]),
    "prepare-sft": (prepare_sft, ["input_dir", "output_dir"]),
    "generate-real-rollouts": (generate_real_rollouts, ["config_path"]),
    "build-preferences": (build_preferences, ["rollout_path"]),
    "prepare-dpo": (prepare_dpo, ["config_path"]),
    "evaluate": (evaluate_predictions, ["dataset_path", "output_path"]),
    "evaluate-rollouts": (evaluate, ["rollout_path", "output_path"]),
    "evaluate-model": (evaluate_model, ["config_path"]),
    "compare-models": (compare_models, ["config_path"]),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pathwright")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (f, args) in COMMANDS.items():
        one = commands.add_parser(name, help=(f.__doc__ or "").split("\n")[0])
        for a in args:
            one.add_argument(a)
        if name == "build-preferences":
            one.add_argument("--output-path")
            one.add_argument("--run-root", default="runs")
            one.add_argument("--run-prefix", default="preferences")
            one.add_argument("--require-chosen-success", action="store_true")
        if name == "evaluate":
            one.add_argument("--predictions-path")
            one.add_argument("--allow-execution", action="store_true")
    given = vars(parser.parse_args(argv))
    f, _ = COMMANDS[given.pop("command")]
    spark = SparkSession.builder.getOrCreate()
    for row in f(spark, **given).toLocalIterator():
        print(json.dumps(row.asDict(True), ensure_ascii=False))


if __name__ == "__main__":
    main()
