"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from pathwright import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return round(v, 12) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted(([plain(r[c]) for c in names] for r in got.collect()), key=str)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert rows == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=str)


def test_rank_does_not_depend_on_partitions(spark):
    from pathwright.operators import ranking
    from pathwright.sources.fixtures import view

    t = view(spark, SF, "trajectories")
    one = {(r.problem_id, r.trajectory_id) for r in ranking.best(t.repartition(7, "pos")).collect()}
    assert one == {(r.problem_id, r.trajectory_id) for r in ranking.best(t.coalesce(1)).collect()}


def test_weights_are_in_bounds(spark):
    for r in QUERIES["pref_weights"](spark, SF).collect():
        assert r.weight_e4 in (8500, 10000) or 3500 <= r.weight_e4 <= 8000


M = "__RESULT__="
#: exit code, timed out, stdout, reference; status, objective, executed, success
RUNS = [
    (0, True, M + "{}", 1.0, "TIMEOUT", None, False, False),
    (1, False, M + "{}", 1.0, "RUNTIME_ERROR", None, False, False),
    (0, False, "x", 1.0, "MISSING_RESULT", None, False, False),
    (0, False, None, 1.0, "MISSING_RESULT", None, False, False),
    (0, False, " " + M + "{}", 1.0, "MISSING_RESULT", None, False, False),
    (0, False, M + "[1]", 1.0, "INVALID_RESULT", None, True, False),
    (0, False, M, 1.0, "INVALID_RESULT", None, True, False),
    (0, False, M + "{'a': ", 1.0, "INVALID_RESULT", None, True, False),
    (0, False, M + '{"status": "OPTIMAL"} x', 1.0, "INVALID_RESULT", None, True, False),
    (0, False, M + '{"status": 0.7, "objective_value": 1}', 1.0, "OPTIMAL", 1.0, True, True),
    (0, False, M + '{"status": -0.5, "objective_value": 1}', 1.0, "OPTIMAL", 1.0, True, True),
    (0, False, M + '{"status": 1e3}', 1.0, "1000", None, True, False),
    (0, False, M + '{"status": true}', 1.0, "1", None, True, False),
    (0, False, M + '{"status": false, "objective_value": true}', 1.0, "OPTIMAL", 1.0, True, True),
    (0, False, M + '{"status": null}', 1.0, "None", None, True, False),
    (0, False, M + '{"status": " optimal ", "objective_value": "1.00005"}', 1.0, "OPTIMAL", 1.00005, True, True),
    (0, False, M + '{"status": "\u00a0optimal", "objective_value": 1.0002}', 1.0, "OPTIMAL", 1.0002, True, False),
    (0, False, M + '{"status": "0"}', 1.0, "0", None, True, False),
    (0, False, M + '{"a": 1}', None, "UNKNOWN", None, True, False),
    (0, False, M + "{'status': 'OPTIMAL', 'objective_value': 5.0}", 5.0, "OPTIMAL", 5.0, True, True),
    (0, False, M + "{'status': True, 'objective_value': None}", 5.0, "1", None, True, False),
    (0, False, M + '{"status": [1], "objective_value": 2}', 2.0, "[1]", 2.0, True, False),
    (0, False, M + '{"status": {"a": "b"}, "objective_value": [2]}', 2.0, "{'a': 'b'}", None, True, False),
    (0, False, M + '{"status": "OPTIMAL", "objective_value": NaN}', 2.0, "OPTIMAL", float("nan"), True, False),
    (0, False, M + '{"status": "OPTIMAL", "objective_value": -Infinity}', 2.0, "OPTIMAL", float("-inf"), True, False),
    (0, False, M + '{"status": "OPTIMAL", "objective_value": "1_0"}', 10.0, "OPTIMAL", 10.0, True, True),
    (0, False, M + '{"status": "OPTIMAL", "objective_value": "3.5d"}', 3.5, "OPTIMAL", None, True, False),
    (0, False, M + '{"status": "x", "status": "OPTIMAL", "objective_value": 3}', 3.0, "OPTIMAL", 3.0, True, True),
    (0, False, M + '{"status": "OPTIMAL", "objective_value": 3}', None, "OPTIMAL", 3.0, True, False),
    (0, False, f'{M}{{"status": 1}}\r{M}{{"status": 0, "objective_value": 4}}\x0bend', 4.0, "OPTIMAL", 4.0, True, True),
]


def test_classification_of_result_lines(spark):
    from pathwright.operators.verify import classify

    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(RUNS)], "i int, exit_code int, timed_out boolean, stdout string, reference_objective double")
    got = {r.i: (r.status, str(r.objective_value), r.execution_ok, r.success) for r in classify(df).collect()}
    assert got == {i: (c[4], str(c[5]), *c[6:]) for i, c in enumerate(RUNS)}


def test_payloads_read_by_the_engine_are_read_as_in_python(spark):
    import itertools

    from pyspark.sql import functions as F

    from pathwright.functions import results

    values = ["0", "-3.99", "1e5", "123456789012345", "null", "true", "false", '" Feasible "', '"\\n"', '"3.5"', '" -2e3 "', '"é"', "[]", '"inf"']
    payloads = [f'{{"status": {a}, "objective_value": {b}, "more": 1}}' for a, b in itertools.product(values, values)]
    df = spark.createDataFrame([(p,) for p in payloads], "p string").select("p", results.result_of(F.col("p")).alias("r"))
    for r in df.collect():
        want = results.read_object(r.p)
        assert (r.r.status, repr(r.r.objective_value)) == (results.status_of(want["status"]), repr(results.objective_of(want["objective_value"]))), r.p


@pytest.mark.parametrize("text, code", [("", ""), ("```python\na\n```", "a"), ("```\na\n``` b ```py\nc\n```", "c"), ("x ```PY\nd", "d"), ("```a``` ```b", "a"), ("plain", "plain"), ("```python\r\na\r\nb\r\n```", "a\nb")])
def test_extract_code(spark, text, code):
    from pathwright.functions.text import extract_code
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(extract_code(F.col("t"))).first()[0] == code


@pytest.mark.parametrize("n", [0, 1, 9, 10, 53])
def test_train_valid(spark, n):
    from pathwright.operators.splits import train_valid

    rows = train_valid(spark.range(n).repartition(3), "id").collect()
    assert sorted(r.id for r in rows if r.split == "train") == list(range(max(1, n * 9 // 10) if n else 0)) and len(rows) == n


def test_splits_of_large_and_hashed_keys(spark):
    from pyspark.sql import functions as F

    from pathwright.operators import splits

    ids = [r.h for r in spark.range(1000).select(F.xxhash64("id").alias("h")).collect()] + [10**12, 9 * 10**9, -5]
    df = spark.createDataFrame([(i,) for i in ids], "h long").repartition(5)
    rows, n = splits.places(df, ["h"], "place")
    assert n == len(ids) and {r.h: r.place for r in rows.collect()} == {h: i for i, h in enumerate(sorted(ids), 1)}
    assert [r.split for r in splits.by_group(df, "h", [("train", 80), ("valid", 10), ("test", 10)]).collect()].count("train") == len(ids) * 80 // 100
    got = splits.running(df, ["h"], F.col("h") % 7, "total").collect()
    total = 0
    for r in sorted(got, key=lambda r: r.h):
        total += r.h - int(r.h / 7) * 7 if abs(r.h) < 2**53 else (abs(r.h) % 7) * (1 if r.h > 0 else -1)
        assert r.total == total
