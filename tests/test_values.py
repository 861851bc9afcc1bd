"""Python's rounding and white space, named functions, sampling and the report, beyond what the queries show."""

import random
import struct
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathwright.functions import named
from pathwright.functions.python_values import SPACES, py_round, rounded_sql, strip
from pathwright.operators import decoding, report


def doubles(n):
    rng, out = random.Random(0), [0.0, -0.0, 2.675, 0.5, 1.5, 2.5, -0.125, 1e308, 5e-324, 2.0**52 + 0.5, 2.0**53]
    kinds = [
        lambda: struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0], lambda: rng.uniform(-1000, 1000), lambda: rng.randrange(-(10**7), 10**7) / 2 ** rng.randrange(1, 12),
        lambda: (rng.randrange(10**9) + 0.5) / 10 ** rng.choice([0, 2, 4, 6]), lambda: rng.uniform(1, 2) * 2 ** rng.randrange(30, 56), lambda: rng.randrange(10**6) * 5 / 10 ** rng.randrange(1, 8),
    ]
    return out + [x for _ in range(n) if (x := rng.choice(kinds)()) == x and abs(x) != float("inf")]


@pytest.mark.parametrize("places", [0, 2, 4, 6])
def test_rounding_is_pythons(spark, places):
    xs = doubles(100_000)
    df = spark.createDataFrame(pd.DataFrame({"x": xs}))
    got = df.select(py_round(F.col("x"), places).alias("a"), F.expr(rounded_sql("x", places)).alias("b")).toPandas()
    want = [float(round(x, places)) for x in xs]
    assert got.a.tolist() == want and got.b.tolist() == want


def test_rounding_of_what_is_no_number(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    a, b, c, d = (r[0] for r in df.select(py_round(F.col("x"), 2)).collect())
    assert a is None and b != b and (c, d) == (float("inf"), float("-inf"))
    with pytest.raises(ValueError, match="places"):
        py_round(F.col("x"), 9)
    assert "Python" not in df.select(py_round(F.col("x"), 2))._jdf.queryExecution().executedPlan().toString()


def test_white_space_is_pythons(spark):
    every = "".join(chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000 and chr(k).isspace())
    assert "".join(sorted(SPACES)) == every and len(every) == 29
    texts = [a + "x" + b + "y" + a for a in every for b in every] + ["​z​", every, "", "\x00 a"]
    named.register(spark)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("a"), F.expr("pw_strip(t)").alias("b")).collect()
    assert all(r.a == r.b == r.t.strip() for r in rows) and len(rows) == len(texts)


def test_named_functions_agree_with_the_engine(spark):
    from pathwright.functions import text as X

    named.register(spark)
    answers = ["a\r\n```python\nx = 1\n```\nb", "```py y```", "open\n```PYTHON\nz", "none 　", "", "Decision Variables\nConstraints", "``` q ```"]
    outs = ["log\n__RESULT__={'status': 0}　", "__RESULT__=1\x85__RESULT__=2", "no", None]
    df = spark.createDataFrame([(a, o) for a in answers for o in outs], "a string, o string")
    own = df.select(X.extract_code(F.col("a")), X.last_marker(F.col("o")), X.process_score_e4(F.col("a"), F.lit(True), F.lit(False))).collect()
    sql = spark.sql("SELECT pw_code(a), pw_last_marker(o), pw_process_score(a, true, false) FROM {df}", df=df).collect()
    assert [tuple(r) for r in own] == [tuple(r) for r in sql]
    got = spark.sql("SELECT pw_payload(pw_last_marker(o)) AS p FROM {df} WHERE o IS NOT NULL", df=df).collect()
    assert {(r.p.status, r.p.ok) for r in got} == {("OPTIMAL", True), (None, None)}
    assert spark.sql("SELECT pw_round(2.675D, 2), pw_round(2.5D, 0), pw_round(NULL, 2)").first() == (2.67, 2.0, None)


def test_samples_follow_their_chances(spark):
    scores = np.array([2.0, 1.0, 0.5, -1.0, 1.0])
    steps = spark.range(4000).select(F.col("id").alias("prompt_id"), F.lit(0).alias("step"), F.array(*map(F.lit, scores.tolist())).alias("scores"))
    for heat, reach in ((1.0, 1.0), (0.5, 0.8), (2.0, 0.6)):
        p = np.exp(scores / heat)
        p /= p.sum()
        order = sorted(range(5), key=lambda i: (-p[i], i))
        kept = order[: int(np.searchsorted(np.cumsum(p[order]), reach - 1e-12)) + 1]
        want = {i: p[i] / p[kept].sum() for i in kept}
        got = Counter(r.token for r in decoding.sample(steps, heat, reach, 4).collect())
        assert set(got) == set(want) and sum(got.values()) == 16_000
        assert all(abs(got[i] / 16_000 - w) < 4 * (w * (1 - w) / 16_000) ** 0.5 + 0.003 for i, w in want.items())
    assert {r.token for r in decoding.sample(steps, 0.0, 1.0, 2).collect()} == {0}
    odd = spark.createDataFrame([(1, 0, None), (2, 0, []), (3, 0, [5.0]), (4, 1, [1e4, -1e4, 1e4])], "prompt_id long, step int, scores array<double>")
    got = {(r.prompt_id, r.sample): r.token for r in decoding.sample(odd, 0.7, 0.9, 2).collect()}
    assert got[1, 1] is None and got[2, 2] is None and got[3, 1] == 0 and {got[4, 1], got[4, 2]} <= {0, 2}
    assert sorted(decoding.sample(steps.repartition(3), 0.7, 0.9, 2).collect()) == sorted(decoding.sample(steps.coalesce(1), 0.7, 0.9, 2).collect())


def test_report_without_runs(spark):
    runs = spark.createDataFrame([(1, "a", 5), (3, "b", 7), (3, "c", 1), (None, "d", 9)], "t int, run string, loss int")
    assert report.latest(runs, "t", "run").collect() == [(3, "c", 1)]
    assert report.latest(runs.where("false"), "t").collect() == []
    row = report.assemble(spark, "R", {"a": (report.latest(runs, "t", "run"), ["run", "loss"]), "b": (report.latest(runs.where("false"), "t"), ["loss"]), "c": (None, ["x"])}, {"drop": F.col("a_loss") - F.col("b_loss")}).first()
    assert (row.a_run, row.a_loss, row.b_loss, row.c_x, row["drop"]) == ("c", 1, None, None, None)
    assert row.report == "# R\n\n- a_run: c\n- a_loss: 1\n- b_loss: -\n- c_x: -\n- drop: -"
