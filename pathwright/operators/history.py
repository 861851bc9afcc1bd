"""Training histories: rows (run, pos, step, loss_c, lr_e9, epoch_c and further metrics, in whole numbers). Rows without a loss or a step are no log points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import ratio
from .splits import running

#: The metrics that a summary tells of, and which end of each is the best.
METRICS = {"mean_token_accuracy": "max", "entropy": "min", "grad_norm": "min", "reward_margin": "max", "preference_accuracy": "max"}
#: What a run's third chart shows, the first that it has.
SHOWN = ("mean_token_accuracy", "reward_margin", "preference_accuracy")


def points(history: DataFrame) -> DataFrame:
    return history.where("loss_c IS NOT NULL AND step IS NOT NULL")


def summary(history: DataFrame, *by: str) -> DataFrame:
    """One row a run: log points, first and last step, first, last and best loss, its reduction, the last epoch and learning rate (0 if not logged)."""
    first, last = (lambda c: F.min_by(c, "pos")), (lambda c: F.max_by(c, "pos"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    loss0, loss1 = first("loss_c"), last("loss_c")
    return points(history).groupBy(*by).agg(
        F.count("*").alias("num_log_points"), first("step").alias("first_step"), last("step").alias("last_step"), loss0.alias("first_loss_c"), loss1.alias("last_loss_c"), F.min("loss_c").alias("best_loss_c"),
        (loss1 - loss0).alias("loss_delta_c"), (loss0 - loss1).alias("loss_reduction_c"), ratio(loss0 - loss1, loss0).alias("relative_loss_reduction"), last(zero(F.col("epoch_c"))).alias("final_epoch_c"), last(zero(F.col("lr_e9"))).alias("final_lr_e9"),
    )


def first_last_best(history: DataFrame, *by: str) -> DataFrame:
    """metric, first_value, last_value, best_value of each metric that a run logged."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_c").alias("v")) for m in METRICS])
    long = points(history).select(*by, "pos", F.explode(rows).alias("x")).select(*by, "pos", "x.metric", "x.v").where("v IS NOT NULL")
    highest = F.col("metric").isin([m for m, best in METRICS.items() if best == "max"])
    return long.groupBy(*by, "metric").agg(F.min_by("v", "pos").alias("first_value"), F.max_by("v", "pos").alias("last_value"), F.when(highest, F.max("v")).otherwise(F.min("v")).alias("best_value"))


def interval_means(steps: DataFrame, run: str, logged: str, values: list[str]) -> DataFrame:
    """run, pos, n and the means of values at each log point, over the steps after the log point before it; steps after the last one wait for the next."""
    at = F.col(logged).cast("int")
    counted = running(steps, [run, "pos"], at, "_part").withColumn("_part", F.col("_part") - at)
    means: list[Column] = [ratio(F.sum(v), F.count("*")).alias(v) for v in values]
    return counted.groupBy(run, "_part").agg(F.max("pos").alias("pos"), F.count("*").alias("n"), F.bool_or(logged).alias("_logged"), *means).where("_logged").drop("_part", "_logged")


def series(history: DataFrame, run: str) -> DataFrame:
    """run, step, loss_c, lr_e9 and the charted metric (`shown`, and its name) of each log point; gaps count 0."""
    has = points(history).groupBy(run).agg(*[(F.count(f"{m}_c") > 0).alias(f"_has_{m}") for m in SHOWN])
    value, name = F.coalesce("grad_norm_c", F.lit(0)), F.lit("grad_norm")
    for m in reversed(SHOWN):
        value, name = F.when(F.col(f"_has_{m}"), F.coalesce(f"{m}_c", F.lit(0))).otherwise(value), F.when(F.col(f"_has_{m}"), F.lit(m)).otherwise(name)
    return points(history).join(has, run).select(run, "step", "loss_c", F.coalesce("lr_e9", F.lit(0)).alias("lr_e9"), value.alias("shown"), name.alias("metric"))
