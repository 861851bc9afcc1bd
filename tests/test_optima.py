"""The exact methods against brute force, and the operators on problems of mixed shapes."""

import random
from collections import Counter
from fractions import Fraction
from itertools import permutations, product

import numpy as np
import pytest

from pathwright.operators import optima as O
from pathwright.operators import solvers as S


@pytest.mark.parametrize("n", range(1, 7))
def test_matchings(n):
    costs = np.random.default_rng(n).integers(-5, 30, (40, n, n))
    best, plan = S.matchings(costs)
    for c, b, p in zip(costs, best, plan, strict=True):
        assert b == min(sum(c[w][t] for w, t in enumerate(q)) for q in permutations(range(n))) == sum(c[w][t] for w, t in enumerate(p)) and sorted(p) == list(range(n))


def test_large_matchings_have_a_proof():
    """A matching is cheapest if no exchange along a cycle lowers it."""
    costs = np.random.default_rng(1).integers(0, 1000, (6, 12, 12))
    best, plan = S.matchings(costs)
    for c, b, p in zip(costs, best, plan, strict=True):
        assert b == c[np.arange(12), p].sum()
        d = c[:, p] - c[np.arange(12), p][:, None]  # what it adds if a worker takes another's task
        for k in range(12):
            d = np.minimum(d, d[:, [k]] + d[[k], :])
        assert (np.diag(d) >= 0).all()


@pytest.mark.parametrize("n", range(1, 8))
def test_tours(n):
    tables = np.random.default_rng(n).integers(1, 60, (15, n, n))
    best, plan = S.tours(tables)
    for d, b, p in zip(tables, best, plan, strict=True):
        length = lambda q, d=d: sum(d[x][y] for x, y in zip((0, *q), (*q, 0), strict=True)) if n > 1 else 0
        assert b == min(map(length, permutations(range(1, n)))) == length(tuple(p[1:])) and sorted(p) == list(range(n))


def test_packing():
    rng = random.Random(0)
    for _ in range(300):
        n = rng.randrange(0, 5)
        weights, values, setups, most = [rng.randrange(6) for _ in range(n)], [rng.randrange(-3, 30) for _ in range(n)], [rng.choice([0, rng.randrange(40)]) for _ in range(n)], [rng.randrange(8) for _ in range(n)]
        room = rng.randrange(60)
        worth = lambda q: sum(a * v - (s if a else 0) for a, v, s in zip(q, values, setups, strict=True))  # noqa: E731, B023
        fits = lambda q: sum(a * w for a, w in zip(q, weights, strict=True)) <= room  # noqa: E731, B023
        best, plan = S.packing(room, weights, values, setups, most)
        assert best == worth(plan) == max(worth(q) for q in product(*[range(m + 1) for m in most]) if fits(q)) and fits(plan) and all(0 <= a <= m for a, m in zip(plan, most, strict=True))


def test_many_units_and_products():
    best, plan = S.packing(40_000, [7] * 12, [11 + k for k in range(12)], [50] * 12, [999] * 12)
    assert plan == [0] * 6 + [719] + [999] * 5 and best == sum(q * (11 + k) - 50 for k, q in enumerate(plan) if q)
    assert S.packing(10**12, [10**9 + k for k in range(30)], [10**6 - k * k for k in range(30)], [0] * 30, [1] * 30)[1] == [1] * 30


def dual(rows, caps, profit):
    return [[-rows[i][j] for i in range(len(rows))] for j in range(len(profit))], [-p for p in profit], [-c for c in caps]


@pytest.mark.parametrize("most", [3, 5, 12])
def test_simplex_has_a_proof(most):
    """A plan and a dual plan of one value; without a plan, the dual has none or no end."""
    rng, seen = random.Random(most), Counter()
    for _ in range(300 if most < 12 else 15):
        m, n = (rng.randrange(1, most + 1), rng.randrange(1, most + 1)) if most < 12 else (12, 12)
        rows, caps, profit = [[rng.randrange(-3 if most < 12 else 1, 7) for _ in range(n)] for _ in range(m)], [rng.randrange(-6, 40) if most < 12 else rng.randrange(60, 400) for _ in range(m)], [rng.randrange(-5, 20) for _ in range(n)]
        status, a, b, x = S.simplex(rows, caps, profit)
        other, c, d, _ = S.simplex(*dual(rows, caps, profit))
        seen[status] += 1
        if status == "OPTIMAL":
            x = [Fraction(*q) for q in x]
            assert min(x) >= 0 and all(sum(u * v for u, v in zip(r, x, strict=True)) <= cap for r, cap in zip(rows, caps, strict=True))
            assert sum(p * v for p, v in zip(profit, x, strict=True)) == Fraction(a, b) == -Fraction(c, d) and other == "OPTIMAL"
        else:
            assert other == "INFEASIBLE" or (status == "INFEASIBLE" and other == "UNBOUNDED")
    assert most == 12 or len(seen) == 3


def test_degenerate_plans():
    assert S.simplex([], [], [1])[0] == "UNBOUNDED" and S.simplex([], [], [-1, 0])[:2] == ("OPTIMAL", 0)
    assert S.simplex([[1], [-1]], [0, 0], [5])[:2] == ("OPTIMAL", 0)
    assert S.simplex([[1, 1], [-1, -1], [1, 1]], [3, -3, 3], [1, 2])[:3] == ("OPTIMAL", 6, 1)
    # a cycle under the usual choice of columns
    rows, profit = [[1, -11, -5, 18], [1, -3, -1, 2], [1, 0, 0, 0]], [10, -57, -9, -24]
    status, a, b, _ = S.simplex(rows, [0, 0, 1], profit)
    assert (status, Fraction(a, b)) == ("OPTIMAL", 1)


def test_operators_with_mixed_shapes(spark):
    rng, rows, want = random.Random(3), [], {}
    for p in range(60):
        n = 1 + p % 5
        c = [[rng.randrange(1, 50) for _ in range(n)] for _ in range(n)]
        rows += [(p, i, j, c[i][j]) for i in range(n) for j in range(n)]
        want[p] = (min(sum(c[w][t] for w, t in enumerate(q)) for q in permutations(range(n))), min((sum(c[x][y] for x, y in zip((0, *q), (*q, 0), strict=True)) for q in permutations(range(1, n))), default=0) if n > 1 else 0)
    rows += [(99, 0, 1, 4), (99, 1, 1, 3)]  # no matching, no round trip
    df = spark.createDataFrame(rows, "problem_id long, i int, j int, v int").repartition(5)
    got = {r.problem_id: r for r in O.assignment(df.selectExpr("problem_id", "i AS w", "j AS t", "v AS cost")).collect()}
    assert got[99].optimum is None and got[99].plan is None and {p: got[p].optimum for p in want} == {p: w[0] for p, w in want.items()}
    trips = {r.problem_id: r for r in O.tour(df.selectExpr("problem_id", "i", "j", "v AS dist")).collect()}
    assert trips[99].optimum is None and {p: trips[p].optimum for p in want} == {p: w[1] for p, w in want.items()}
    assert O.tour(df.selectExpr("problem_id", "i", "j", "v AS dist").where("false")).collect() == []


def test_knapsacks_of_all_sizes(spark):
    rng, rows, want = random.Random(4), [], {}
    for p in range(40):
        n = 1 + p % 14
        items = [(rng.randrange(1, 40), rng.randrange(1, 12)) for _ in range(n)]
        room = sum(w for _, w in items) // 2
        rows += [(p, k, v, w, room) for k, (v, w) in enumerate(items)]
        best = [0] * (room + 1)
        for v, w in items:
            for at in range(room, w - 1, -1):
                best[at] = max(best[at], best[at - w] + v)
        want[p] = best[room]
    got = O.knapsack(spark.createDataFrame(rows, "problem_id long, pos int, value int, weight int, capacity int")).collect()
    assert {r.problem_id: r.optimum for r in got} == want
    of = {(p, k): (v, w, room) for p, k, v, w, room in rows}
    for r in got:
        chosen = [of[r.problem_id, k] for k, q in enumerate(r.plan) if q]
        assert sum(c[0] for c in chosen) == r.optimum and sum(c[1] for c in chosen) <= of[r.problem_id, 0][2]
