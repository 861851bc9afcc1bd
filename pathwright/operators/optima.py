"""Exact optima of any number of instances of any size that its method can take: one row a problem is packed by its key, and tasks
solve their rows in numpy, problems of one shape at once (see `solvers`)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import solvers

#: Knapsacks of at most so many items are solved together, over all subsets; cells of tables that a task solves at once.
TOGETHER = 8
CELLS = 1 << 21
#: The cost of what is not in a table.
_NONE = 1 << 40


def _packed(df: DataFrame, fields: list[str], **more: Column) -> DataFrame:
    """One row a problem: `items` in order of the fields, as whole numbers."""
    return df.groupBy("problem_id").agg(F.array_sort(F.collect_list(F.struct(*[F.col(f).cast("bigint").alias(f) for f in fields]))).alias("items"), *[c.alias(n) for n, c in more.items()])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Where each row's items begin, how many there are, and their fields."""
    offsets, flat = column.offsets.to_numpy(), column.flatten()
    return offsets[:-1] - offsets[0], np.diff(offsets), {flat.type.field(k).name: flat.field(k).to_numpy(zero_copy_only=False) for k in range(flat.type.num_fields)}


Answers = tuple[list, list]


def _solved(packed: DataFrame, method: Callable[[pa.RecordBatch], Answers], value: T.DataType, *fields: T.StructField) -> DataFrame:
    """problem_id, what `fields` name, optimum and plan of each row."""
    schema = T.StructType([packed.schema["problem_id"], *fields, T.StructField("optimum", value), T.StructField("plan", T.ArrayType(T.DoubleType()))])
    kind = pa.float64() if isinstance(value, T.DoubleType) else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *first, optimum, plan = method(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, first), pa.array(optimum, kind), pa.array(plan, pa.list_(pa.float64()))], names=schema.names)

    return packed.mapInArrow(run, schema)


def _shapes(sizes: np.ndarray, cells: Callable[[int], int]) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each size, in lots of bounded memory."""
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        lot = max(1, CELLS // max(1, cells(n)))
        yield from ((n, rows[at : at + lot]) for at in range(0, len(rows), lot))


def knapsack(items: DataFrame) -> DataFrame:
    """problem_id, optimum, plan (1 for each chosen item, else 0): best value of a subset of the items (problem_id, pos, value, weight, capacity) within
    capacity. Few items are tried in all subsets, more by their undominated subsets. Of equal values the plan of few items has the fewest of the last ones."""

    def method(batch: pa.RecordBatch) -> Answers:
        at, sizes, x = _lists(batch.column(1))
        room, optimum, plan = batch.column(2).to_numpy(zero_copy_only=False), [0] * batch.num_rows, [[]] * batch.num_rows
        for n, rows in _shapes(sizes, lambda n: 1 << min(n, TOGETHER)):
            take = at[rows][:, None] + np.arange(n)
            weights, values = x["weight"][take], x["value"][take]
            if n <= TOGETHER:
                best, chosen = solvers.subsets(room[rows], weights, values)
            else:
                best, chosen = zip(*(solvers.packing(int(room[r]), w, v, [0] * n, [1] * n) for r, w, v in zip(rows, weights.tolist(), values.tolist(), strict=True)), strict=True)
            for r, b, c in zip(rows.tolist(), best, chosen, strict=True):
                optimum[r], plan[r] = int(b), [float(q) for q in c]
        return optimum, plan

    return _solved(_packed(items, ["pos", "value", "weight"], capacity=F.max("capacity").cast("bigint")), method, T.LongType())


def _tables(batch: pa.RecordBatch, i: str, j: str, value: str, cells: Callable[[int], int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows with square tables of one size, and the tables; what is missing costs _NONE."""
    at, count, x = _lists(batch.column(1))
    row = np.repeat(np.arange(batch.num_rows), count)
    sizes = np.zeros(batch.num_rows, np.int64)
    np.maximum.at(sizes, row, np.maximum(x[i], x[j]) + 1)
    place = np.zeros(batch.num_rows, np.int64)
    for n, rows in _shapes(sizes, cells):
        tables = np.full((len(rows), n, n), _NONE)
        place[rows] = np.arange(len(rows))
        some = np.isin(row, rows)
        tables[place[row[some]], x[i][some], x[j][some]] = x[value][some]
        yield n, rows, tables


def assignment(costs: DataFrame) -> DataFrame:
    """problem_id, optimum, plan (the task of each worker): cheapest matching of each worker with a task of its own over the costs
    (problem_id, w, t, cost) numbered from 0. A pair that is missing may not be matched: a problem without a matching has neither optimum nor plan."""

    def method(batch: pa.RecordBatch) -> Answers:
        optimum, plan = [None] * batch.num_rows, [None] * batch.num_rows
        for _, rows, tables in _tables(batch, "w", "t", "cost", lambda n: n * n):
            best, tasks = solvers.matchings(tables)
            for r, b, p in zip(rows.tolist(), best.tolist(), tasks.tolist(), strict=True):
                if b < _NONE // 2:
                    optimum[r], plan[r] = b, [float(t) for t in p]
        return optimum, plan

    return _solved(_packed(costs, ["w", "t", "cost"]), method, T.LongType())


def tour(arcs: DataFrame) -> DataFrame:
    """problem_id, optimum, plan (the cities in their order from 0): shortest round trip over the arcs (problem_id, i, j, dist) of cities
    numbered from 0, by the shortest ways over all sets of cities. A problem without a round trip has neither optimum nor plan; one of more than 18 cities raises an error."""

    def method(batch: pa.RecordBatch) -> Answers:
        optimum, plan = [None] * batch.num_rows, [None] * batch.num_rows
        for n, rows, tables in _tables(batch, "i", "j", "dist", lambda n: n << n):
            if n > solvers.MOST_CITIES:
                raise ValueError(f"a tour of {n} cities; at most {solvers.MOST_CITIES}")
            best, order = solvers.tours(tables)
            for r, b, p in zip(rows.tolist(), best.tolist(), order.tolist(), strict=True):
                if b < _NONE // 2:
                    optimum[r], plan[r] = b, [float(c) for c in p]
        return optimum, plan

    return _solved(_packed(arcs, ["i", "j", "dist"]), method, T.LongType())


def production(products: DataFrame) -> DataFrame:
    """problem_id, optimum, plan (units by product): most net profit of whole numbers of units (problem_id, pos, margin, setup, max_units, labor;
    total_hours), a setup being paid once a product is made. Any number of products and units."""

    def method(batch: pa.RecordBatch) -> Answers:
        at, sizes, x = _lists(batch.column(1))
        optimum, plan = [], []
        for lo, n, room in zip(at.tolist(), sizes.tolist(), batch.column(2).to_pylist(), strict=True):
            best, units = solvers.packing(room, *(x[f][lo : lo + n].tolist() for f in ("labor", "margin", "setup", "max_units")))
            optimum.append(best)
            plan.append([float(q) for q in units])
        return optimum, plan

    return _solved(_packed(products, ["pos", "margin", "setup", "max_units", "labor"], left=F.max("total_hours").cast("bigint")), method, T.LongType())


def linear(products: DataFrame) -> DataFrame:
    """problem_id, status, optimum (double), plan (quantity by product): largest profit of a continuous plan (problem_id, pos, profit, uses: what one
    unit takes of each limit; caps: the limits, the same in each row of a problem) by the simplex method in whole numbers; quotients come last.
    Limits and uses may be negative. status is OPTIMAL, INFEASIBLE or UNBOUNDED; only the first has an optimum and a plan."""
    whole = lambda c: F.transform(c, lambda v: v.cast("bigint"))
    packed = products.groupBy("problem_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("profit").cast("bigint").alias("profit"), whole("uses").alias("uses")))).alias("items"), whole(F.max("caps")).alias("caps"))

    def method(batch: pa.RecordBatch) -> tuple[list, list, list]:
        status, optimum, plan = [], [], []
        for items, caps in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            rows = [[item["uses"][k] for item in items] for k in range(len(caps))]
            state, a, b, amounts = solvers.simplex(rows, caps, [item["profit"] for item in items])
            status.append(state)
            optimum.append(solvers.quotient(a, b) if amounts else None)
            plan.append([solvers.quotient(*q) for q in amounts] if amounts else None)
        return status, optimum, plan

    return _solved(packed, method, T.DoubleType(), T.StructField("status", T.StringType()))


def solve(instances: DataFrame) -> DataFrame:
    """seed, template_name, status, objective_value, metadata of instances (see `instances`), each family by its own exact method. metadata is
    the plan as JSON: quantities, units and opened products, tasks of workers, chosen items, or the number of cities. A row without an optimum is FAILED."""
    named = instances.withColumnRenamed("seed", "problem_id")
    of = lambda t: named.where(F.col("template_name") == t)

    def facts(t, *fields):
        zipped = F.arrays_zip(*[F.col("facts")[f].alias(f) for f in fields])
        return of(t).select("problem_id", "limits", "cells", F.posexplode(zipped).alias("pos", "x"))

    p = facts("production_planning", "margin", "setup_cost", "max_units", "labor_hours").select("problem_id", "pos", "x.margin", F.col("x.setup_cost").alias("setup"), "x.max_units", F.col("x.labor_hours").alias("labor"), F.get("limits", F.lit(0)).alias("total_hours"))
    k = facts("knapsack", "value", "weight").select("problem_id", "pos", "x.value", "x.weight", F.get("limits", F.lit(0)).alias("capacity"))
    lp = facts("resource_allocation", "profit").select("problem_id", "pos", "x.profit", F.transform("cells", lambda row: F.get(row, F.col("pos"))).alias("uses"), F.col("limits").alias("caps"))
    grid = lambda t, i, j, v: of(t).select("problem_id", F.posexplode("cells").alias(i, "row")).select("problem_id", i, F.posexplode("row").alias(j, v))
    solved = linear(lp).drop("status")
    for one in (production(p), knapsack(k), assignment(grid("assignment", "w", "t", "cost")), tour(grid("tsp", "i", "j", "dist").where("i <> j"))):
        solved = solved.unionByName(one.select("problem_id", F.col("optimum").cast("double").alias("optimum"), "plan"))
    got = instances.select("seed", "template_name", "names", "others").join(solved.withColumnRenamed("problem_id", "seed"), "seed", "left")
    by = lambda values: F.map_from_arrays("names", values)
    plans = {
        "resource_allocation": F.struct(by(F.col("plan")).alias("solution")),
        "production_planning": F.struct(by(F.col("plan")).alias("production"), by(F.transform("plan", lambda x: (x > 0).cast("double"))).alias("open")),
        "assignment": F.struct(by(F.transform("plan", lambda x: F.get("others", x.cast("int")))).alias("assignment")),
        "knapsack": F.struct(F.filter("names", lambda n, i: F.get("plan", i) > 0).alias("chosen_items")),
        "tsp": F.struct(F.size("names").alias("city_count")),
    }
    metadata = None
    for name, x in plans.items():
        metadata = F.when(F.col("template_name") == name, F.to_json(x)) if metadata is None else metadata.when(F.col("template_name") == name, F.to_json(x))
    return got.select("seed", "template_name", F.when(F.col("optimum").isNull(), "FAILED").otherwise("OPTIMAL").alias("status"), F.col("optimum").alias("objective_value"), F.when(F.col("plan").isNotNull(), metadata).alias("metadata"))
