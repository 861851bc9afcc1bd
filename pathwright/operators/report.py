"""One report row from the latest runs of several stages; a stage that never ran leaves its part empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(runs: DataFrame, time: str, *tie: str) -> DataFrame:
    """The row of the greatest time (then of the greatest `tie`), found by partial maxima; no row for no runs."""
    fields = F.struct(time, *tie, *[c for c in runs.columns if c not in (time, *tie)])
    return runs.where(F.col(time).isNotNull()).agg(F.max(fields).alias("x")).where("x IS NOT NULL").select("x.*")


def assemble(spark: SparkSession, title: str, parts: dict[str, tuple[DataFrame | None, list[str]]], deltas: dict[str, Column]) -> DataFrame:
    """One row: the fields of each part (one row, none, or no source at all) as <part>_<field>, the deltas, and the report as Markdown
    with a line a field, in which `-` stands for what is not known."""
    out = spark.range(1).drop("id")
    names: list[str] = []
    for part, (df, fields) in parts.items():
        own = [f"{part}_{f}" for f in fields]
        if df is None:
            out = out.withColumns(dict.fromkeys(own, F.lit(None).cast("string")))
        else:
            out = out.join(df.limit(1).select(*[F.col(f).alias(n) for f, n in zip(fields, own, strict=True)]), how="left", on=F.lit(True))  # one row a side
        names += own
    out = out.select("*", *[v.alias(k) for k, v in deltas.items()])
    line = lambda n: F.concat(F.lit(f"- {n}: "), F.coalesce(F.col(n).cast("string"), F.lit("-")))
    return out.withColumn("report", F.concat_ws("\n", F.lit(f"# {title}"), F.lit(""), *[line(n) for n in [*names, *deltas]]))
