"""Queries without SQL: exact optima of generated instances, repaired code, padded batches."""

import json
from itertools import permutations, product

import pytest
from pyspark.sql import functions as F

from pathwright.functions import repair
from pathwright.operators import instances as I
from pathwright.operators import optima as O


def best(r):
    """Brute force; None for the continuous family."""
    n, facts = len(r.names), r.facts
    if r.template_name == "assignment":
        return min(sum(r.cells[w][t] for w, t in enumerate(p)) for p in permutations(range(4)))
    if r.template_name == "tsp":
        return min(sum(r.cells[a][b] for a, b in zip((0, *p), (*p, 0), strict=True)) for p in permutations(range(1, n)))
    if r.template_name == "knapsack":
        sets = (m for m in product((0, 1), repeat=n) if sum(x * w for x, w in zip(m, facts["weight"], strict=True)) <= r.limits[0])
        return max(sum(x * v for x, v in zip(m, facts["value"], strict=True)) for m in sets)
    if r.template_name == "production_planning":
        top = {0: 0}
        for m, s, x, h in zip(facts["margin"], facts["setup_cost"], facts["max_units"], facts["labor_hours"], strict=True):
            after = {}
            for used, v in top.items():
                for q in range(x + 1):
                    if used + q * h <= r.limits[0]:
                        after[used + q * h] = max(after.get(used + q * h, -1e9), v + (q * m - s if q else 0))
            top = after
        return max(top.values())
    return None


@pytest.fixture(scope="module")
def made(spark):
    return I.instances(spark.range(200).withColumnRenamed("id", "seed"))


def test_optima_of_instances(made):
    want = {r.seed: best(r) for r in made.collect()}
    rows = O.solve(made).collect()
    assert len(rows) == 200 and {r.status for r in rows} == {"OPTIMAL"}
    for r in rows:
        assert want[r.seed] is None or r.objective_value == want[r.seed], r
        assert r.objective_value > 0


def worth(r, m):
    """What a plan is worth, and whether it keeps the limits."""
    n, f = len(r.names), r.facts
    if r.template_name == "assignment":
        tasks = [r.others.index(m["assignment"][w]) for w in r.names]
        return sum(r.cells[w][t] for w, t in enumerate(tasks)), sorted(tasks) == list(range(4))
    if r.template_name == "tsp":
        return None, m["city_count"] == n
    if r.template_name == "knapsack":
        chosen = [x in m["chosen_items"] for x in r.names]
        return sum(v for v, c in zip(f["value"], chosen, strict=True) if c), sum(w for w, c in zip(f["weight"], chosen, strict=True) if c) <= r.limits[0]
    if r.template_name == "production_planning":
        q = [m["production"][x] for x in r.names]
        assert [m["open"][x] for x in r.names] == [float(v > 0) for v in q]
        fits = all(0 <= v <= top for v, top in zip(q, f["max_units"], strict=True)) and sum(v * h for v, h in zip(q, f["labor_hours"], strict=True)) <= r.limits[0]
        return sum(v * g - (s if v else 0) for v, g, s in zip(q, f["margin"], f["setup_cost"], strict=True)), fits
    q = [m["solution"][x] for x in r.names]
    fits = min(q) >= 0 and all(sum(u * v for u, v in zip(row, q, strict=True)) <= c + 1e-9 for row, c in zip(r.cells, r.limits, strict=True))
    return pytest.approx(sum(p * v for p, v in zip(f["profit"], q, strict=True))), fits


def test_plans_of_instances(made):
    rows = {r.seed: r for r in made.collect()}
    for r in O.solve(made).collect():
        value, fits = worth(rows[r.seed], json.loads(r.metadata))
        assert fits and (value is None or r.objective_value == value), r
        assert rows[r.seed].scenario in I.SCENARIOS[r.template_name]


def test_instances_keep_their_bounds_and_do_not_depend_on_partitions(spark, made):
    rows = {r.seed: r for r in made.collect()}
    assert rows == {r.seed: r for r in I.instances(spark.range(0, 200, 1, 9).withColumnRenamed("id", "seed").repartition(5)).collect()}
    assert {r.template_name for r in rows.values()} == set(I.POOLS)
    for r in rows.values():
        low, high = I.SIZES[r.template_name]
        assert low <= len(r.names) <= high and len(set(r.names)) == len(r.names) and set(r.names) <= set(I.POOLS[r.template_name])
        for field, (a, b) in I.FACTS[r.template_name].items():
            assert all(a <= v <= b for v in r.facts[field]) and len(r.facts[field]) == len(r.names)


def test_payload_and_question(made):
    for r in I.questions(I.payload(made)).collect():
        x = json.loads(r.instance)
        assert list(x)[0] in ("products", "workers", "items", "cities") and all(n in r.question for n in r.names)
        if r.template_name == "tsp":
            assert all(x["distances"][a][b] == x["distances"][b][a] and x["distances"][a][a] == 0 for a in r.names for b in r.names)


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


MARK = 'print("__RESULT__=" + json.dumps(\n    {"a": [1,\n 2]}\n))'


@pytest.mark.parametrize(
    "code, body",
    [
        ("", ""),
        ("intro\nimport os\nx = 1", "import os\nx = 1"),
        ("python\nimport os", "import os"),
        ("import os\n<step>\ny = 2\n  </step>", "import os\ny = 2"),
        (f"import os\nif 1:\n  {MARK}\nz = 3", f"import os\nif 1:\n  {repair.PRINT}\nz = 3"),
        ("import os\r\nsolver.Minimize(x)\r\nresult = 1", "import os\nsolver.Minimize(x)\nstatus = solver.Solve()\nresult = 1"),
        ("from a.b import c\nimport os\nx.value()", "import os\nx.solution_value()"),
        ("import os\nm = cp_model.CpModel()", "from ortools.sat.python import cp_model\nimport os\nm = cp_model.CpModel()"),
        ("import os\nprint('é中')", "import os\nprint('é中')"),
    ],
)
def test_postprocess(spark, code, body):
    got = one(spark, repair.postprocess, code)
    end = "" if repair.PRINT in body else "\n\n" + repair.FOOTER
    assert got == (repair.PREAMBLE + "\n\n" + (body + end).strip())
    compile(got, "answer", "exec")


def test_postprocess_of_null_and_long_text(spark):
    assert one(spark, repair.answer_code, None) is None
    long = "import os\n" + "x = [1, (2)]\n" * 20000 + MARK
    got = one(spark, repair.postprocess, long)
    assert got.count("x = [1, (2)]") == 20000 and got.endswith(repair.PRINT)


def test_runnable_code_reports_its_result(spark, tmp_path):
    import subprocess
    import sys

    code = one(spark, repair.answer_code, "So:\n```python\nimport os\nresult = {'status': 'OPTIMAL', 'objective_value': 4.5}\n```")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, timeout=60).stdout
    assert json.loads(out.strip().removeprefix("__RESULT__=")) == {"status": "OPTIMAL", "objective_value": 4.5}
