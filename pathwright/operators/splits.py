"""Global positions and running sums without a single-task window, and what is built on them.

Rows are put in order by range over all tasks and written once to the shared folder, so that the order stands. A task's rows are then
numbered where they are; what lies before a task is a sum over earlier tasks, one number a task, which the driver adds up."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import jsonl

_ROW = (1 << 33) - 1


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df in the order of `order`, with _task and _row, written and read again. Equal rows lie together."""
    at = F.monotonically_increasing_id()
    path = jsonl.scratch(df.sparkSession, "ranged")
    df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(at, 33).cast("int").alias("_task"), at.bitwiseAND(F.lit(_ROW)).alias("_row")).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _offsets(sums: dict[int, int]) -> Column:
    """What comes before each task."""
    tasks = range(max(sums, default=-1) + 1)
    before = accumulate((sums.get(t) or 0 for t in tasks), initial=0)
    return F.array(*[F.lit(x).cast("bigint") for x in before])


def places(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """df with its rows numbered from 1 in the order of `order`, and how many there are."""
    rows = _ranged(df, order)
    sums = {r[0]: r[1] for r in rows.groupBy("_task").count().collect()}  # one row a task
    return rows.withColumn(name, F.get(_offsets(sums), F.col("_task")) + F.col("_row") + 1).drop("_task", "_row"), sum(sums.values())


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the running sum of value in the order of `order`."""
    rows = _ranged(df, order)
    sums = {r[0]: r[1] for r in rows.groupBy("_task").agg(F.sum(value)).collect()}  # one row a task
    own = F.sum(value).over(Window.partitionBy("_task").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, (F.coalesce(own, F.lit(0)) + F.get(_offsets(sums), F.col("_task"))).cast("bigint")).drop("_task", "_row")


def shuffle_key(c: Column) -> Column:
    """A fixed integer scramble: an order that does not depend on partitions. Of any whole number."""
    return (F.pmod(c, F.lit(2147483648)) * 1103515245 + 12345) % 2147483648


def until_target(attempts: DataFrame, target: int) -> DataFrame:
    """Attempts up to and including the target-th success, in the order seed, variant, trajectory; with the running count."""
    got = running(attempts, ["seed", "variant", "traj"], F.col("success").cast("int"), "accepted")
    return got.where((F.col("accepted") < target) | (F.col("success") & (F.col("accepted") == target)))


def train_valid(df: DataFrame, *order: str) -> DataFrame:
    """The first nine tenths in the order of the columns (at least one row) are `train`, the rest `valid`."""
    got, n = places(df, list(order), "place")
    return got.withColumn("split", F.when(F.col("place") <= max(1, n * 9 // 10), "train").otherwise("valid"))


def by_group(groups: DataFrame, key: str, shares: list[tuple[str, int]]) -> DataFrame:
    """Splits whole groups: each gets its share (in percent, rounded down) of the scrambled order, the last one the rest."""
    got, n = places(groups.withColumn("_key", shuffle_key(F.col(key))), ["_key", key], "place")
    split, reach = F.lit(shares[-1][0]), 0
    bounds = []
    for name, percent in shares[:-1]:
        reach += n * percent // 100
        bounds.append((name, reach))
    for name, top in reversed(bounds):
        split = F.when(F.col("place") <= top, name).otherwise(split)
    return got.withColumn("split", split).drop("_key")
