"""Ranking of a problem's trajectories, and preference pairs of the best and the worst.

Order: success, objective match, teacher score, process score (all descending; a missing score counts 0), and among equals
the one that came first. The best is the first of this order, the worst the last. Scores are integers (tenths)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keys() -> list[Column]:
    return [F.col("success").cast("int"), F.col("objective_match").cast("int"), F.coalesce("teacher_c", F.lit(0)), F.coalesce("process_c", F.lit(0))]


def rank(trajectories: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("problem_id").orderBy(*[k.desc() for k in keys()], "pos"))
    return trajectories.withColumn("rank", place)


def best(trajectories: DataFrame, *by: str) -> DataFrame:
    """The best trajectory of each problem; a partial maximum of (keys, -pos) on the map side, so one row a group is shuffled."""
    top = F.max(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys())], (-F.col("pos")).alias("p"), *[F.col(c) for c in trajectories.columns if c not in ("problem_id", *by)]))
    return trajectories.groupBy(*by, "problem_id").agg(top.alias("t")).select(*by, "problem_id", *[F.col(f"t.{c}").alias(c) for c in trajectories.columns if c not in ("problem_id", *by)])


_CARRIED = ("trajectory_id", "success", "objective_match", "teacher_c", "process_c")


def pairs(trajectories: DataFrame) -> DataFrame:
    """problem_id, template_name, chosen, rejected (structs) of problems with two trajectories or more."""
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys())], (-F.col("pos")).alias("p"), *[F.col(c) for c in _CARRIED])
    got = trajectories.groupBy("problem_id", "template_name").agg(F.max(key).alias("chosen"), F.min(key).alias("rejected"), F.count("*").alias("n"))
    return got.where((F.col("n") >= 2) & (F.col("chosen.trajectory_id") != F.col("rejected.trajectory_id")))


def weigh(pairs: DataFrame) -> DataFrame:
    """pairs with weight_e4 (the weight in ten-thousandths) and its rationale."""
    c, r = F.col("chosen"), F.col("rejected")
    teacher = F.greatest(F.coalesce(c["teacher_c"], F.lit(0)) - F.coalesce(r["teacher_c"], F.lit(0)), F.lit(0))
    process = F.coalesce(c["process_c"], F.lit(0)) - F.coalesce(r["process_c"], F.lit(0))
    rules = [
        (c["success"] & ~r["success"], F.lit(10000), "solver_success_beats_failure"),
        (c["objective_match"] & ~r["objective_match"], F.lit(8500), "objective_match_beats_mismatch"),
        (teacher > 0, F.least(F.lit(8000), 3500 + 450 * teacher), "teacher_score_gap"),
        (F.lit(True), F.least(F.lit(8000), 3000 + F.greatest(F.lit(500), 1000 * process)), "process_score_gap"),
    ]
    weight = reason = None
    for test, value, name in rules:
        weight = F.when(test, value) if weight is None else weight.when(test, value)
        reason = F.when(test, F.lit(name)) if reason is None else reason.when(test, F.lit(name))
    return pairs.select("problem_id", "template_name", F.col("chosen.trajectory_id").alias("chosen_id"), F.col("rejected.trajectory_id").alias("rejected_id"), F.col("chosen.success").alias("chosen_success"), F.round(weight).cast("bigint").alias("weight_e4"), reason.alias("rationale"))
