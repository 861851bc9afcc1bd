"""Records of rollouts and datasets as JSON lines, and their flat forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERIFICATION = "struct<success: boolean, execution_ok: boolean, status: string, objective_value: double, objective_match: boolean, tolerance: double, stdout: string, stderr: string, error_message: string>"
JUDGEMENT = "struct<overall_score: string, step_score: string, code_score: string, verdict: string, strengths: array<string>, issues: array<string>, rationale: string, model: string>"
TRAJECTORY = f"struct<trajectory_id: string, response: string, code: string, verification: {VERIFICATION}, process_score: double, source: string, teacher_evaluation: {JUDGEMENT}>"
ROLLOUT = f"problem_id string, template_name string, question string, reference_solution struct<status: string, objective_value: double, metadata: string>, trajectories array<{TRAJECTORY}>"
DATASET = f"problem_id string, split string, template_name string, question string, response string, code string, instance string, reference_solution struct<status: string, objective_value: double, metadata: string>, verification {VERIFICATION}"


def score(text: Column) -> Column:
    """A judge's score; 0 for what is no finite number, true and false count 1 and 0."""
    known = F.when(F.lower(text) == "true", 1.0).when(F.lower(text) == "false", 0.0).otherwise(text.try_cast("double"))
    return F.coalesce(F.nanvl(known, F.lit(0.0)), F.lit(0.0))


def given_score(text: Column) -> Column:
    """A judge's score; null where there is none or it is no number."""
    return F.when(F.lower(text).isin("true", "false") | text.try_cast("double").isNotNull(), score(text))


def trajectories(rollouts: DataFrame, *whole: str) -> DataFrame:
    """One row a trajectory, as `ranking` takes them: pos, flags, and scores in tenths. whole: further fields to carry."""
    t = rollouts.select("problem_id", "template_name", "question", F.col("reference_solution.objective_value").alias("reference"), F.posexplode("trajectories").alias("pos", "t"))
    v = lambda f: F.coalesce(F.col(f"t.verification.{f}"), F.lit(False)).alias(f)
    return t.select(
        "problem_id", "template_name", "question", "pos", F.col("t.trajectory_id").alias("trajectory_id"), F.col("t.response").alias("response"), F.col("t.code").alias("code"), v("success"), v("execution_ok"), v("objective_match"),
        F.col("t.verification.status").alias("status"), (F.col("t.verification.objective_value") - F.col("reference")).alias("objective_gap"), (score(F.col("t.teacher_evaluation.overall_score")) * 10).alias("teacher_c"), (F.coalesce("t.process_score", F.lit(0.0)) * 10).alias("process_c"),
        given_score(F.col("t.teacher_evaluation.overall_score")).alias("teacher_score"), *[F.col(f"t.{f}").alias(f) for f in whole],
    )
