"""Rollouts read as a stream of JSON lines: the best trajectory of each problem and counts by status, kept by Structured Streaming's state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import records
from ..operators import ranking as R


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of trajectories."""
    return records.trajectories(spark.readStream.schema(records.ROLLOUT).json(folder))


def status_counts(trajectories: DataFrame) -> DataFrame:
    """For the complete or update output mode; one state a status."""
    return trajectories.groupBy("status").agg(F.count("*").alias("n"))


def best(trajectories: DataFrame) -> DataFrame:
    """For the update output mode; one state a problem. A problem's later rollouts must keep counting pos upwards for ties to stay in order."""
    return R.best(trajectories)
