"""Sampling from scores: temperature, nucleus and draw in one pass each over a step's sorted scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.python_values import py_round
from .instances import draw

#: Draws are whole numbers below this.
GRAIN = 524288


def schedule(n: Column, low: float, high: float, single: float = 0.3) -> Column:
    """The temperatures of n samples, from low to high in equal steps, in hundredths; `single` for one sample or none."""
    steps = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: py_round(F.lit(low) + i * F.lit(high - low) / F.nullif(n - 1, F.lit(0)), 2))
    return F.when(n <= 1, F.array(F.lit(single))).otherwise(steps)


def _pick(sorted_: Column, kept: Column, u: Column) -> Column:
    """The token at which the running weight first passes u of the kept weight."""
    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("int").alias("token"))
    step = lambda s, x: F.struct((s["run"] - x["w"]).alias("run"), F.when(s["token"].isNotNull(), s["token"]).when(s["run"] - x["w"] > u * kept, x["i"]).alias("token"))
    return F.aggregate(sorted_, start, step)["token"]


def sample(steps: DataFrame, temperature: float, top_p: float = 1.0, samples: int = 1, salt: int = 0) -> DataFrame:
    """prompt_id, step, sample (from 1), token of steps (prompt_id, step, scores): `samples` tokens a step, of those of largest score whose
    chances first reach top_p. A token's chance grows with exp(score / temperature); temperature 0 takes the largest score each time. Ties go to the
    smaller token. Draws are functions of prompt, step, sample and salt, so the same tokens come out of any partitioning. Null or empty scores give null."""
    heat = temperature if temperature > 0 else 1.0
    top = F.array_max("scores")
    # negative weights, so that the order is rising
    own = F.array_sort(F.transform("scores", lambda x, i: F.struct((-F.exp((x - top) / heat)).alias("w"), i.alias("i"))))
    rows = steps.select("prompt_id", "step", own.alias("own"), F.aggregate(own, F.lit(0.0), lambda a, x: a - x["w"]).alias("total"))
    reach = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("kept"))
    more = lambda s, x: F.struct((s["run"] - x["w"]).alias("run"), F.when(s["kept"].isNotNull(), s["kept"]).when(s["run"] - x["w"] >= top_p * F.col("total"), s["run"] - x["w"]).alias("kept"))
    nucleus = F.aggregate("own", reach, more)
    rows = rows.select("prompt_id", "step", "own", F.coalesce(nucleus["kept"], nucleus["run"]).alias("kept"))
    rows = rows.select("prompt_id", "step", "own", "kept", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample"))
    u = (draw(F.lit(salt) + F.col("step").cast("bigint") * 64 + F.col("sample"), 0, GRAIN - 1, F.col("prompt_id").cast("bigint")) + 0.5) / GRAIN
    token = _pick(F.col("own"), F.col("kept"), u) if temperature > 0 else F.get("own", F.lit(0))["i"]
    return rows.select("prompt_id", "step", "sample", token.alias("token"))
