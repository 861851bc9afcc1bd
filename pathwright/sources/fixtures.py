"""Views that give the star-schema tables the shapes of the engine's records. One SQL text serves Spark and the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TRAJECTORIES = """
SELECT l_orderkey AS problem_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'resource_allocation' WHEN '2' THEN 'production_planning' WHEN '3' THEN 'assignment' WHEN '4' THEN 'knapsack' ELSE 'tsp' END AS template_name,
  pos, CAST(l_suppkey % 3 AS INT) AS model_no, concat(CAST(l_orderkey AS STRING), '::sample', CAST(pos AS STRING)) AS trajectory_id,
  CASE l_returnflag WHEN 'A' THEN 'OPTIMAL' WHEN 'R' THEN 'FEASIBLE' ELSE 'RUNTIME_ERROR' END AS status,
  l_returnflag <> 'N' AS execution_ok, l_linestatus = 'F' AS objective_match, (l_returnflag = 'A' AND l_linestatus = 'F') AS success,
  CASE WHEN l_tax = 0 THEN NULL ELSE CAST(round(l_discount * 100) AS INT) END AS teacher_c, CAST(round(l_tax * 100) AS INT) AS process_c,
  CASE WHEN l_returnflag <> 'N' THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS objective_c, CAST(round(o_totalprice * 100) AS BIGINT) AS reference_c
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS pos FROM {lineitem}) AS l
JOIN {orders} AS o ON l_orderkey = o_orderkey
"""

DATASET = """
SELECT o_orderkey AS problem_id, CASE WHEN o_orderkey % 10 = 8 THEN 'valid' WHEN o_orderkey % 10 = 9 THEN 'test' ELSE 'train' END AS split,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'resource_allocation' WHEN '2' THEN 'production_planning' WHEN '3' THEN 'assignment' WHEN '4' THEN 'knapsack' ELSE 'tsp' END AS template_name,
  concat('Problem ', CAST(o_orderkey AS STRING), ': find the best plan.') AS question, concat('Answer of ', CAST(o_custkey AS STRING)) AS response
FROM {orders}
"""

ATTEMPTS = """
SELECT o_orderkey AS attempt_key, CAST(floor(o_orderkey / 6) AS BIGINT) AS seed, CAST(floor((o_orderkey % 6) / 3) AS INT) AS variant, CAST(o_orderkey % 3 AS INT) AS traj, o_orderstatus = 'F' AS success,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'resource_allocation' WHEN '2' THEN 'production_planning' WHEN '3' THEN 'assignment' WHEN '4' THEN 'knapsack' ELSE 'tsp' END AS template_name
FROM {orders}
"""

RESPONSES = """
SELECT doc_id, concat(CASE WHEN doc_id % 9 > 0 THEN 'Problem Description\n' ELSE '' END, CASE WHEN doc_id % 9 > 1 THEN 'Sets and Parameters\n' ELSE '' END, CASE WHEN doc_id % 9 > 2 THEN 'Decision Variables\n' ELSE '' END,
  CASE WHEN doc_id % 9 > 3 THEN 'Objective Function\n' ELSE '' END, CASE WHEN doc_id % 9 > 4 THEN 'Constraints\n' ELSE '' END,
  CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN concat('Here:\n```python\n', text, '\n```\nDone.') WHEN 2 THEN concat('```py\nx = 1\n```\nand\n```\n', text, '\n```') WHEN 3 THEN concat('Unclosed\n```PYTHON\n', text) ELSE concat('so\nimport json\n', text, '\nmodel = f([1, (2)') END) AS response
FROM {documents}
"""

#: Each way in which a run ends, and each kind of result line; # stands for a quotation mark of Python.
EXECUTIONS = """
SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code, event_id % 50 = 0 AS timed_out, value AS reference_objective,
  CASE event_id % 16 WHEN 0 THEN 'no marker here' WHEN 1 THEN concat('log\n__RESULT__={{"status": "OPTIMAL", "objective_value": ', CAST(CAST(floor(value) AS BIGINT) AS STRING), '}}')
    WHEN 2 THEN '__RESULT__={{"status": 0, "objective_value": "3.5"}}' WHEN 3 THEN '__RESULT__=[1, 2]' WHEN 4 THEN '__RESULT__={{"status": " feasible ", "objective_value": null}}'
    WHEN 5 THEN '__RESULT__={{"status": "OPTIMAL"}}\n__RESULT__={{"status": 2, "objective_value": 7}}\nend' WHEN 6 THEN '__RESULT__=not json' WHEN 7 THEN '__RESULT__={{"objective_value": "abc"}}'
    WHEN 8 THEN replace('__RESULT__={{#status#: #OPTIMAL#, #objective_value#: 5.0}}', '#', chr(39)) WHEN 9 THEN replace('__RESULT__={{#status#: True, #objective_value#: None}}', '#', chr(39))
    WHEN 10 THEN '__RESULT__={{"status": [1], "objective_value": 2}}' WHEN 11 THEN '__RESULT__={{"status": "optimal", "objective_value": true}}' WHEN 12 THEN '__RESULT__={{"status": "OPTIMAL", "objective_value": NaN}}'
    WHEN 13 THEN '__RESULT__={{"status": {{"code": 1}}, "objective_value": [1]}}' WHEN 14 THEN '__RESULT__={{"status": "OPTIMAL", "status": "FEASIBLE", "objective_value": "1_000"}}' ELSE '__RESULT__={{"status": "OPTIMAL"}} {{"status": "OPTIMAL"}}' END AS stdout
FROM {events}
"""

#: Log rows of training runs, in whole numbers: some without a loss (evaluation), with gaps in the metrics that not every trainer logs.
LOG_HISTORY = """
SELECT event_type AS run_id, pos, CASE WHEN event_id % 13 <> 0 THEN pos * 5 END AS step, CASE WHEN event_id % 11 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS loss_c, CASE WHEN event_id % 17 <> 0 THEN 200000 - pos END AS lr_e9, CASE WHEN event_id % 17 <> 1 THEN pos * 3 END AS epoch_c,
  CASE WHEN event_id % 5 <> 0 THEN user_id % 91 END AS grad_norm_c, user_id % 100 AS entropy_c, CASE WHEN event_type <> 'error' THEN (user_id * 7 + event_id) % 101 END AS mean_token_accuracy_c, CASE WHEN event_id % 3 = 0 THEN event_id % 61 - 30 END AS reward_margin_c, CASE WHEN event_id % 4 = 0 THEN event_id % 97 END AS preference_accuracy_c, event_id % 7 = 0 AS logged, event_id
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos FROM {events}) AS e
"""

KNAP_ITEMS = """
SELECT problem_id, pos, CAST(l_quantity AS BIGINT) AS value, l_partkey % 9 + 2 AS weight, CAST(floor(sum(l_partkey % 9 + 2) OVER (PARTITION BY problem_id) / 2) AS BIGINT) AS capacity
FROM (SELECT l_orderkey AS problem_id, l_quantity, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS pos FROM {lineitem}) AS l
WHERE pos <= 6
"""

PROD_PARAMS = """
SELECT *, CAST(floor(sum(labor * max_units) OVER (PARTITION BY problem_id) * 55 / 100) AS BIGINT) AS total_hours
FROM (SELECT CAST(floor(p_partkey / 4) AS BIGINT) AS problem_id, CAST(p_partkey % 4 AS INT) AS pos, CAST(18 + p_size % 19 AS BIGINT) AS margin, CAST(45 + (p_partkey * 7) % 66 AS BIGINT) AS setup, CAST(8 + p_size % 13 AS BIGINT) AS max_units, CAST(2 + p_partkey % 5 AS BIGINT) AS labor FROM {part}) AS p
"""

LP_PARAMS = """
SELECT *, CAST(floor(sum(u0) OVER (PARTITION BY problem_id) * (45 + problem_id % 21) / 10) AS BIGINT) AS cap0, CAST(floor(sum(u1) OVER (PARTITION BY problem_id) * (45 + problem_id * 5 % 21) / 10) AS BIGINT) AS cap1, CAST(floor(sum(u2) OVER (PARTITION BY problem_id) * (45 + problem_id * 8 % 21) / 10) AS BIGINT) AS cap2
FROM (SELECT CAST(floor(p_partkey / 4) AS BIGINT) AS problem_id, CAST(p_partkey % 4 AS INT) AS pos, CAST(18 + (p_size * 3 + p_partkey) % 31 AS BIGINT) AS profit, CAST(1 + p_partkey % 6 AS BIGINT) AS u0, CAST(1 + (p_partkey * 5 + p_size) % 6 AS BIGINT) AS u1,
  CAST(CASE WHEN floor(p_partkey / 4) % 2 = 0 THEN 0 ELSE 1 + (p_size * 7) % 6 END AS BIGINT) AS u2 FROM {part}) AS p
"""

VIEWS = {"prod_params": PROD_PARAMS, "lp_params": LP_PARAMS, "trajectories": TRAJECTORIES, "dataset": DATASET, "attempts": ATTEMPTS, "responses": RESPONSES, "executions": EXECUTIONS, "log_history": LOG_HISTORY, "knap_items": KNAP_ITEMS}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables of sf_dir."""
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"(?<!\{)\{(\w+)\}", text))})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(name: str) -> str:
    """The view's SQL over tables of their own names; texts with line feeds are spelled as the other dialect has them."""
    text = re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", VIEWS[name]).replace("{{", "{").replace("}}", "}")
    return text


def with_views(sql: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({oracle(n)})" for n in names) + (", " + sql.removeprefix("WITH ") if sql.startswith("WITH ") else " " + sql)
