"""Queries over all rows, against brute force."""

import re

from pathwright import catalog, prompts
from pathwright.functions import text as X
from pathwright.operators import instances as I
from pathwright.sources.fixtures import view

SF = "/root/testdata/sf0.001"


def first_code(text):
    found = [m.start() for p in X.CODE_STARTS if (m := re.search(p, text, re.ASCII))]
    return min(found, default=None)


def test_code_start_of_every_response(spark):
    got = {r.doc_id: r.start for r in catalog.queries()["code_start"](spark, SF).collect()}
    want = {r.doc_id: first_code(r.response) for r in view(spark, SF, "responses").collect()}
    assert got == want and {i % 5 for i in got} == set(range(5))


def test_code_start_by_each_pattern(spark):
    lines = ["import os", "from a import b", "def f(x):", "model = 1", "manager=1", "routing = r", "data = {", "solver = s", "from a.b import c", "data = []", " import os", "imports"]
    texts = [f"some wörds 😀\n{line}\nimport late" for line in lines] + ["", "none here", None]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert {r.i: r.s for r in df.select("i", X.code_start(F.col("t")).alias("s")).collect()} == {i: None if t is None else first_code(t) for i, t in enumerate(texts)}


def asked(r):
    """The question of an instance, by its rows."""
    return f"Setting: {r.scenario}\n" + asked_plainly(r)


def asked_plainly(r):
    facts = lambda i, *parts: "".join(f"{p}{r.facts[f][i]}" for p, f in parts)
    each = lambda *parts: [f"- {n}: " + facts(i, *parts) for i, n in enumerate(r.names)]
    table = lambda cols: [f"- {n}: " + ", ".join(f"{c} {v}" for c, v in zip(cols, row, strict=True)) for n, row in zip(r.names, r.cells, strict=True)]
    if r.template_name == "resource_allocation":
        uses = [f"- {o}: {limit} in all; one unit takes " + ", ".join(f"{n} {v}" for n, v in zip(r.names, row, strict=True)) for o, limit, row in zip(r.others, r.limits, r.cells, strict=True)]
        return "\n".join(["How much of each product gives the largest profit?", *each(("profit ", "profit")), *uses])
    if r.template_name == "production_planning":
        return "\n".join([f"Which products should be made, and how many units, for the largest net profit within {r.limits[0]} hours?", *each(("margin ", "margin"), (", setup ", "setup_cost"), (", hours ", "labor_hours"), (", at most ", "max_units"))])
    if r.template_name == "assignment":
        return "\n".join(["Give each worker one task and each task one worker at the least cost.", *table(r.others)])
    if r.template_name == "tsp":
        return "\n".join(["What is the shortest round trip through all cities?", *table(r.names)])
    return "\n".join([f"Which items give the most value within a weight of {r.limits[0]}?", *each(("value ", "value"), (", weight ", "weight"))])


def test_questions_of_every_instance(spark):
    made = I.instances(spark.read.parquet(f"{SF}/customer.parquet").selectExpr("c_custkey AS seed")).collect()
    got = catalog.queries()["render_question"](spark, SF).collect()
    assert sorted((r.seed, r.template_name, r.question) for r in got) == sorted((r.seed, r.template_name, asked(r)) for r in made)
    assert {r.template_name for r in got} == set(I.POOLS) and len(got) == spark.read.parquet(f"{SF}/customer.parquet").count()


def below(plan, node):
    """The nodes of a plan's text that stand below those of this name; a text in a node may have line feeds."""
    found, depth = [], None
    for line in re.split(r"\n(?=[ :]*[+:]- )", plan):
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at > depth:
            found.append(line)
        else:
            depth = at if line.lstrip(" :+-").startswith(node) else None
    return found


def test_dpo_prompts_are_not_broadcast(spark):
    """Spark estimates a made text at 20 bytes: 900,000 orders' prompts passed for a small side, and the driver ran out of memory."""
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) >= 10 << 20  # Spark's default: both sides are small here
    got = catalog.queries()["dpo_rows"](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Question:" in plan and below(plan, "BroadcastExchange")
    assert not any("Question:" in line or "Problem " in line for line in below(plan, "BroadcastExchange"))
    asked = {r.problem_id: (r.template_name, r.question) for r in view(spark, SF, "dataset").collect()}
    weighed = {r.problem_id: r for r in catalog.queries()["pref_weights"](spark, SF).collect()}
    rows = got.collect()
    assert len(rows) == len(weighed) > 0
    for r in rows:
        template, question = asked[r.problem_id]
        w = weighed[r.problem_id]
        assert r.prompt == f"system={prompts.ANSWER}\nuser=Family: {template}\nHint: {prompts.HINTS.get(template, prompts.OTHER)}\n\nQuestion:\n{question}"
        assert (r.chosen, r.rejected, r.weight_e4, r.rationale) == (w.chosen_id, w.rejected_id, w.weight_e4, w.rationale)
