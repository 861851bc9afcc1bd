"""Registering sources and sinks of one's own."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource


def register(spark: SparkSession, source: type[DataSource]) -> None:
    """Makes the source known to the session, unless a session that it shares its sources with has done so."""
    try:
        spark.dataSource.register(source)
    except AnalysisException as e:
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise
