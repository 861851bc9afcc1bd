"""Best-of-n metrics, counts and histograms. Sums are integers; divisions come last, so that results do not depend on order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def best_of_n(best: DataFrame, *by: str) -> DataFrame:
    n = F.count(F.lit(1))
    teacher, seen = F.sum(F.col("teacher_c").cast("bigint")), F.count("teacher_c")
    both = F.abs(F.col("objective_c") - F.col("reference_c"))
    squares = F.sum(F.col("teacher_c").cast("bigint") * F.col("teacher_c"))
    got = best.groupBy(*by).agg(
        n.alias("num_examples"),
        ratio(F.count_if("execution_ok"), n).alias("execution_rate"),
        ratio(F.count_if(F.col("status") == "OPTIMAL"), n).alias("feasible_rate"),
        ratio(F.count_if("success"), n).alias("pass_at_1"),
        (ratio(F.sum(both), F.count(both)) / 100).alias("mean_abs_objective_gap"),
        (ratio(teacher, seen) / 10).alias("teacher_mean_score"),
        (ratio(seen * squares - teacher * teacher, seen * seen) / 100).alias("teacher_var_score"),
    )
    return got.na.fill(0.0).withColumn("teacher_std_score", F.sqrt("teacher_var_score"))


def best_of_n_sql(by: str = "") -> str:
    d = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"
    gap, t = "abs(objective_c - reference_c)", "CAST(teacher_c AS BIGINT)"
    var = f"coalesce(({d(f'(count(teacher_c) * sum({t} * {t}) - sum({t}) * sum({t}))', '(count(teacher_c) * count(teacher_c))')}) / 100, 0.0)"
    return f"""count(*) AS num_examples, {d('count(*) FILTER (WHERE execution_ok)', 'count(*)')} AS execution_rate, {d("count(*) FILTER (WHERE status = 'OPTIMAL')", 'count(*)')} AS feasible_rate,
      {d('count(*) FILTER (WHERE success)', 'count(*)')} AS pass_at_1, coalesce(({d(f'sum({gap})', f'count({gap})')}) / 100, 0.0) AS mean_abs_objective_gap, coalesce(({d(f'sum({t})', 'count(teacher_c)')}) / 10, 0.0) AS teacher_mean_score,
      {var} AS teacher_var_score, sqrt({var}) AS teacher_std_score"""


def histogram(df: DataFrame, column: str) -> DataFrame:
    """bin, n: equal-width bins over [min, max], the last one closed; their number follows the count. Integer arithmetic."""
    some = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("bigint").alias("x")).count()
    bounds = some.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.least(F.lit(12), F.greatest(F.lit(5), F.floor(F.sum("count") / 3))).cast("bigint").alias("bins"))
    place = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.expr("(x - lo) * bins div (hi - lo)"), F.col("bins") - 1))
    return some.join(F.broadcast(bounds)).groupBy(place.cast("bigint").alias("bin")).agg(F.sum("count").cast("bigint").alias("n"))  # bounds is one row


def histogram_sql(source: str, column: str) -> str:
    return f"""SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least((x - lo) * bins // (hi - lo), bins - 1) END AS BIGINT) AS bin, count(*) AS n
      FROM (SELECT CAST({column} AS BIGINT) AS x FROM {source} WHERE {column} IS NOT NULL) AS v,
      (SELECT min({column}) AS lo, max({column}) AS hi, least(12, greatest(5, count({column}) // 3)) AS bins FROM {source}) AS b GROUP BY 1"""
