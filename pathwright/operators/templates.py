"""The families that problems come from: the five of `instances`, and those that a user registers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import instances as I
from . import optima as O

MADE = ["seed", "template_name", "question", "instance"]
SOLVED = ["seed", "status", "objective_value", "metadata"]


@dataclass(frozen=True)
class Family:
    """make(seeds) gives question and instance (JSON) for rows with a long seed; solve(made) gives status, objective_value and metadata (JSON) of these by seed."""

    name: str
    make: Callable[[DataFrame], DataFrame]
    solve: Callable[[DataFrame], DataFrame]


_REGISTERED: dict[str, Family] = {}


def register(family: Family) -> None:
    """Adds a family, or puts it in place of the registered one of its name. The five have their names to themselves."""
    if family.name in I.POOLS:
        raise ValueError(f"{family.name} is a family of the engine")
    _REGISTERED[family.name] = family


def names() -> list[str]:
    return [*I.POOLS, *_REGISTERED]


def problems(seeds: DataFrame, weights: dict[str, int]) -> DataFrame:
    """seed, template_name, question, instance and reference_solution of each seed, its family drawn by the weights. A null seed gives no row; a seed that its family does not solve gives none either."""
    if unknown := set(weights) - set(names()):
        raise ValueError(f"unknown families: {', '.join(sorted(unknown))}")
    own = [name for name in weights if name in I.POOLS]
    parts = []
    if own:
        made = I.questions(I.payload(I.instances(seeds, weights, own)))
        parts.append((made.select(*MADE), O.solve(made)))
    drawn = seeds.where("seed IS NOT NULL").withColumn("_template", I.choose(weights))
    for family in (_REGISTERED[name] for name in weights if name in _REGISTERED):
        made = family.make(drawn.where(F.col("_template") == family.name).drop("_template")).withColumn("template_name", F.lit(family.name))
        parts.append((made.select(*MADE), family.solve(made)))
    out = None
    for made, solved in parts:
        solution = F.struct("status", F.col("objective_value").cast("double").alias("objective_value"), "metadata").alias("reference_solution")
        one = made.join(solved.select(*SOLVED).select("seed", solution), "seed")
        out = one if out is None else out.unionByName(one)
    return out
