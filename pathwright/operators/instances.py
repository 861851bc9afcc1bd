"""Random instances of the five problem families, their questions and their payloads; every draw is a function of the instance's
seed and the drawn field, so the same rows come out of any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The names that instances draw from, in the order of the pools.
POOLS = {
    "resource_allocation": ["EcoFuel", "PrimeSteel", "SmartGlass", "AeroFoam", "FlexCircuit", "BioResin"],
    "production_planning": ["battery packs", "control units", "sensor kits", "power modules", "cooling racks"],
    "assignment": ["Alex", "Bailey", "Casey", "Drew", "Emery", "Finley"],
    "knapsack": ["portable scanner", "thermal camera", "relay box", "backup battery", "edge server", "sensor pod", "field router"],
    "tsp": ["Aster", "Brook", "Cedar", "Delta", "Elm", "Fjord", "Grove"],
}
RESOURCES = ["machine hours", "raw material", "skilled labor"]
TASKS = ["routing audit", "inventory sync", "line inspection", "order batching"]
SCENARIOS = {
    "resource_allocation": ["advanced materials workshop", "precision fabrication studio", "green manufacturing line"],
    "production_planning": ["智能工厂周生产计划", "电子装配车间周排产", "工业设备小批量计划"],
    "assignment": ["运筹调度团队", "运营优化小组", "物流协调班组"],
    "knapsack": ["应急运维背包", "现场部署设备包", "移动巡检资源包"],
    "tsp": ["巡检巴士路线", "城际配送路线", "服务工程师访问路线"],
}
#: Fewest and most names of an instance.
SIZES = {"resource_allocation": (3, 5), "production_planning": (3, 4), "assignment": (4, 4), "knapsack": (5, 6), "tsp": (5, 6)}
#: Bounds (inclusive) of the facts about each name.
FACTS = {
    "resource_allocation": {"profit": (18, 48)},
    "production_planning": {"margin": (18, 36), "setup_cost": (45, 110), "max_units": (8, 20), "labor_hours": (2, 6)},
    "assignment": {},
    "knapsack": {"value": (12, 45), "weight": (2, 10)},
    "tsp": {},
}
#: Bounds of the table's cells, and of the thousandths of a sum that give a limit.
CELLS = {"resource_allocation": (1, 6), "assignment": (8, 28), "tsp": (12, 60)}
LIMITS = {"resource_allocation": (4500, 6500), "production_planning": (450, 700), "knapsack": (400, 650)}

#: Salts of the drawn fields; each leaves room for 64 places.
SIZE, RESOURCE_COUNT, NAME, TASK, FACT, CELL, LIMIT, TEMPLATE, SCENARIO = (64 * i for i in range(9))


def draw_sql(seed: str, salt: str, low: int | str, high: int | str) -> str:
    """SQL of a whole number in [low, high] for (seed, salt): two linear congruential steps, the high bits of the second. Any dialect."""
    mixed = f"((CAST({seed} AS BIGINT) % 2147483648 * 1103515245 + CAST({salt} AS BIGINT) * 12820163 + 12345) % 2147483648 * 69069 + 907633385) % 2147483648"
    mixed = f"(({mixed}) * 1664525 + 1013904223) % 2147483648"
    return f"({low} + CAST(floor(({mixed}) / 4096) AS BIGINT) % ({high} - {low} + 1))"


def draw(salt: int | Column, low: int, high: int, seed: Column | None = None) -> Column:
    mixed = ((F.col("seed") if seed is None else seed) % 2147483648 * 1103515245 + F.lit(salt).cast("bigint") * 12820163 + 12345) % 2147483648
    mixed = ((mixed * 69069 + 907633385) % 2147483648 * 1664525 + 1013904223) % 2147483648
    return low + F.floor(mixed / 4096).cast("bigint") % (high - low + 1)


def choose(weights: dict[str, int], salt: int = TEMPLATE) -> Column:
    """A name drawn by whole-number weights."""
    x, reach, out = draw(salt, 0, sum(weights.values()) - 1), sum(weights.values()), None
    for name, w in reversed(weights.items()):
        reach -= w
        out = F.lit(name) if out is None else F.when(x < reach + w, name).otherwise(out)
    return out


def _order(salt: int, n: int) -> Column:
    """The places 0 to n - 1, shuffled."""
    keyed = F.transform(F.array(*[F.lit(k) for k in range(n)]), lambda k: F.struct(draw(F.lit(salt) + k, 0, 524287).alias("d"), k.alias("k")))
    return F.transform(F.array_sort(keyed), lambda x: x["k"])


def _named(places: Column, pool: list[str]) -> Column:
    names = F.array(*[F.lit(x) for x in pool])
    return F.transform(places, lambda k: F.get(names, k))


def _one(seeds: DataFrame, template: str) -> DataFrame:
    low, high = SIZES[template]
    pool = POOLS[template]
    df = seeds.withColumn("_n", draw(SIZE, low, high).cast("int"))
    df = df.withColumn("names", _named(F.slice(_order(NAME, len(pool)), F.lit(1), F.col("_n")), pool))
    places = F.sequence(F.lit(0), F.col("_n") - 1)
    drawn = lambda salt, bounds: F.transform(places, lambda i: draw(F.lit(salt) + i, *bounds))
    per = {name: drawn(FACT + 8 * f, b) for f, (name, b) in enumerate(FACTS[template].items())}
    facts = F.create_map(*[x for name, v in per.items() for x in (F.lit(name), v)]) if per else F.expr("CAST(map() AS map<string, array<bigint>>)")
    nothing = F.expr("CAST(array() AS array<array<bigint>>)")
    no_names, no_limits = F.expr("CAST(array() AS array<string>)"), F.expr("CAST(array() AS array<bigint>)")
    if template == "resource_allocation":
        df = df.withColumn("others", F.slice(F.array(*[F.lit(r) for r in RESOURCES]), F.lit(1), draw(RESOURCE_COUNT, 2, 3).cast("int")))
        rows = F.sequence(F.lit(0), F.size("others") - 1)
        cells = F.transform(rows, lambda r: F.transform(places, lambda i: draw(F.lit(CELL) + r * 8 + i, *CELLS[template])))
    elif template == "assignment":
        df = df.withColumn("others", _named(_order(TASK, len(TASKS)), TASKS))
        cells = F.transform(places, lambda r: F.transform(places, lambda i: draw(F.lit(CELL) + r * 8 + i, *CELLS[template])))
    elif template == "tsp":
        df = df.withColumn("others", no_names)
        cells = F.transform(places, lambda r: F.transform(places, lambda i: F.when(r == i, F.lit(0).cast("bigint")).otherwise(draw(F.lit(CELL) + F.least(r, i) * 8 + F.greatest(r, i), *CELLS[template]))))
    else:
        df, cells = df.withColumn("others", no_names), nothing
    df = df.withColumns({"facts": facts, "cells": cells})
    add = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    part = lambda total, k: F.floor(total * draw(F.lit(LIMIT) + k, *LIMITS[template]) / 1000).cast("bigint")
    if template == "resource_allocation":
        limits = F.transform("cells", lambda row, k: part(add(row), k))
    elif template == "production_planning":
        limits = F.array(part(add(F.zip_with(F.col("facts")["max_units"], F.col("facts")["labor_hours"], lambda a, b: a * b)), F.lit(0)))
    elif template == "knapsack":
        limits = F.array(part(add(F.col("facts")["weight"]), F.lit(0)))
    else:
        limits = no_limits
    scenario = F.get(F.array(*[F.lit(x) for x in SCENARIOS[template]]), draw(SCENARIO, 0, len(SCENARIOS[template]) - 1).cast("int"))
    return df.select(*seeds.columns, F.lit(template).alias("template_name"), "names", "others", "facts", "cells", limits.alias("limits"), scenario.alias("scenario"))


def instances(seeds: DataFrame, weights: dict[str, int] | None = None, only: list[str] | None = None) -> DataFrame:
    """seeds (with a long `seed`) with template_name, names (products, workers, items, cities), others (resources, tasks), facts (field to
    values by name), cells (usage by resource and product, cost by worker and task, distance), limits and scenario. A null seed gives no row, nor does a seed
    whose family is drawn but not among `only`, if that is given."""
    weights = weights or dict.fromkeys(POOLS, 1)
    chosen = seeds.where("seed IS NOT NULL").withColumn("_template", choose(weights))
    out = None
    for template in weights if only is None else only:
        one = _one(chosen.where(F.col("_template") == template).drop("_template"), template)
        out = one if out is None else out.unionByName(one)
    return out


def long(df: DataFrame) -> DataFrame:
    """seed, template_name, field, i, j, value of every number of the instances; names are left out. One pass over the instances."""
    zero = F.lit(0)
    row = lambda field, i, j, v: F.struct(field.alias("field"), i.alias("i"), j.alias("j"), v.alias("value"))
    facts = F.flatten(F.transform(F.map_entries("facts"), lambda e: F.transform(e["value"], lambda v, i: row(e["key"], i, zero, v))))
    cells = F.flatten(F.transform("cells", lambda r, i: F.transform(r, lambda v, j: row(F.lit("cell"), i, j, v))))
    limits = F.transform("limits", lambda v, i: row(F.lit("limit"), i, zero, v))
    return df.select("seed", "template_name", F.explode(F.concat(facts, cells, limits)).alias("x")).select("seed", "template_name", "x.*")


def payload(df: DataFrame) -> DataFrame:
    """df with `instance`: JSON with one object a field, keyed by name, as records carry it."""
    names, others = F.col("names"), F.col("others")
    by = lambda keys, values: F.map_from_arrays(keys, values)
    fact = lambda f: by(names, F.col("facts")[f])
    table = lambda rows, cols: by(rows, F.transform("cells", lambda r: by(cols, r)))
    shapes = {
        "resource_allocation": {"products": names, "resources": others, "profits": fact("profit"), "usage": table(others, names), "capacities": by(others, F.col("limits"))},
        "production_planning": {"products": names, "margin": fact("margin"), "setup_cost": fact("setup_cost"), "max_units": fact("max_units"), "labor_hours": fact("labor_hours"), "total_hours": F.get("limits", F.lit(0))},
        "assignment": {"workers": names, "tasks": others, "costs": table(names, others)},
        "knapsack": {"items": names, "values": fact("value"), "weights": fact("weight"), "capacity": F.get("limits", F.lit(0))},
        "tsp": {"cities": names, "distances": table(names, names)},
    }
    out = None
    for name, fields in shapes.items():
        text = F.to_json(F.struct(*[v.alias(k) for k, v in (fields | {"scenario": F.col("scenario")}).items()]))
        out = F.when(F.col("template_name") == name, text) if out is None else out.when(F.col("template_name") == name, text)
    return df.withColumn("instance", out)


def _lines(*parts) -> Column:
    """One line a name; a part is a text or a field of facts."""
    zipped = F.arrays_zip(F.col("names"), *[F.col("facts")[p[0]].alias(p[0]) for p in parts if isinstance(p, tuple)])
    return F.array_join(F.transform(zipped, lambda x: F.concat(F.lit("- "), x["names"], *[x[p[0]].cast("string") if isinstance(p, tuple) else F.lit(p) for p in parts])), "\n")


def questions(df: DataFrame) -> DataFrame:
    """df with `question`: the scenario, then the instance in words, one line a product, worker, item or city."""
    limit = F.get("limits", F.lit(0)).cast("string")
    listed = lambda cols, row: F.array_join(F.zip_with(cols, row, lambda c, v: F.concat(c, F.lit(" "), v.cast("string"))), ", ")
    rows = F.array_join(F.zip_with("names", "cells", lambda n, r: F.concat(F.lit("- "), n, F.lit(": "), listed(F.when(F.col("template_name") == "tsp", F.col("names")).otherwise(F.col("others")), r))), "\n")
    uses = F.array_join(F.zip_with("others", F.arrays_zip(F.col("cells").alias("c"), F.col("limits").alias("l")), lambda o, x: F.concat(F.lit("- "), o, F.lit(": "), x["l"].cast("string"), F.lit(" in all; one unit takes "), listed(F.col("names"), x["c"]))), "\n")
    texts = {
        "resource_allocation": F.concat(F.lit("How much of each product gives the largest profit?\n"), _lines(": profit ", ("profit",)), F.lit("\n"), uses),
        "production_planning": F.concat(F.lit("Which products should be made, and how many units, for the largest net profit within "), limit, F.lit(" hours?\n"), _lines(": margin ", ("margin",), ", setup ", ("setup_cost",), ", hours ", ("labor_hours",), ", at most ", ("max_units",))),
        "assignment": F.concat(F.lit("Give each worker one task and each task one worker at the least cost.\n"), rows),
        "knapsack": F.concat(F.lit("Which items give the most value within a weight of "), limit, F.lit("?\n"), _lines(": value ", ("value",), ", weight ", ("weight",))),
        "tsp": F.concat(F.lit("What is the shortest round trip through all cities?\n"), rows),
    }
    out = None
    for name, text in texts.items():
        out = F.when(F.col("template_name") == name, text) if out is None else out.when(F.col("template_name") == name, text)
    return df.withColumn("question", F.concat(F.lit("Setting: "), "scenario", F.lit("\n"), out))
