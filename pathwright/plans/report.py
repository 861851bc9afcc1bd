"""The report over the latest runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as P
from ..registry import query
from ..sources.fixtures import table, view

_FIELDS = ["training_run", "training_first_loss", "training_last_loss", "rollout_run", "rollout_n", "rollout_ok", "base_pass_e4", "dpo_pass_e4", "published_id", "loss_drop", "pass_gain_e4"]
_MODEL = "SELECT CAST(sum(CAST(success AS INT)) * 10000 // count(*) AS BIGINT) FROM trajectories WHERE model_no = {}"


@query(f"""WITH ended AS (SELECT log_history.run_id, first_loss, last_loss, t FROM (SELECT run_id, arg_min(loss_c, pos) AS first_loss, arg_max(loss_c, pos) AS last_loss FROM log_history WHERE loss_c IS NOT NULL GROUP BY run_id) AS log_history JOIN (SELECT event_type AS run_id, max(ts) AS t FROM events GROUP BY event_type) USING (run_id)),
  train AS (SELECT * FROM ended ORDER BY t DESC, run_id DESC LIMIT 1),
  roll AS (SELECT o_orderdate AS day, count(*) AS n, CAST(sum(CAST(l_returnflag = 'A' AS INT)) AS BIGINT) AS ok FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderdate ORDER BY o_orderdate DESC LIMIT 1),
  facts AS (SELECT train.run_id AS training_run, first_loss AS training_first_loss, last_loss AS training_last_loss, strftime(day, '%Y-%m-%d') AS rollout_run, n AS rollout_n, ok AS rollout_ok, ({_MODEL.format(0)}) AS base_pass_e4, ({_MODEL.format(2)}) AS dpo_pass_e4, CAST(NULL AS VARCHAR) AS published_id FROM train, roll),
  delta AS (SELECT *, training_first_loss - training_last_loss AS loss_drop, dpo_pass_e4 - base_pass_e4 AS pass_gain_e4 FROM facts)
  SELECT *, concat_ws(chr(10), '# Runs', '', {", ".join(f"concat('- {f}: ', coalesce(CAST({f} AS VARCHAR), '-'))" for f in _FIELDS)}) AS report FROM delta""", "log_history", "trajectories")
def report(s, d):
    """Training, rollouts and comparison of the latest runs, and a stage that never ran."""
    log = view(s, d, "log_history").where("loss_c IS NOT NULL").groupBy("run_id").agg(F.min_by("loss_c", "pos").alias("first_loss"), F.max_by("loss_c", "pos").alias("last_loss"))
    training = P.latest(log.join(table(s, d, "events").groupBy(F.col("event_type").alias("run_id")).agg(F.max("ts").alias("t")), "run_id"), "t", "run_id")
    days = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderdate").agg(F.count("*").alias("n"), F.sum((F.col("l_returnflag") == "A").cast("bigint")).alias("ok"))
    rollout = P.latest(days, "o_orderdate").withColumn("run", F.date_format("o_orderdate", "yyyy-MM-dd"))
    passed = view(s, d, "trajectories").groupBy("model_no").agg(F.expr("sum(CAST(success AS BIGINT)) * 10000 div count(*)").alias("pass_e4"))
    parts = {
        "training": (training.withColumnRenamed("run_id", "run"), ["run", "first_loss", "last_loss"]),
        "rollout": (rollout, ["run", "n", "ok"]),
        "base": (passed.where("model_no = 0"), ["pass_e4"]),
        "dpo": (passed.where("model_no = 2"), ["pass_e4"]),
        "published": (None, ["id"]),
    }
    return P.assemble(s, "Runs", parts, {"loss_drop": F.col("training_first_loss") - F.col("training_last_loss"), "pass_gain_e4": F.col("dpo_pass_e4") - F.col("base_pass_e4")})
