"""Files of runs: the latest one of a pattern, JSON objects, paths from one file to another."""

from __future__ import annotations

import json
import os
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession


def latest(spark: SparkSession, pattern: str) -> str | None:
    """The path that was written last of those that match; of equal times the greatest path. Only the listing is read, in any file system of Spark."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return max(((f.getModificationTime(), f.getPath().toString()) for f in found if f.isFile()), default=(0, None))[1]


def read_json(spark: SparkSession, path: str) -> Any:
    """A file that holds one JSON value, over any number of lines."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one file


def latest_json(spark: SparkSession, pattern: str) -> dict[str, Any]:
    path = latest(spark, pattern)
    return (read_json(spark, path) if path else None) or {}


def write_json(path: str, value: Any) -> None:
    """An indented file of the driver's file system, for a summary."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")


def relative(start: str, path: str | None) -> str:
    """path as seen from the folder of the file start; empty for None."""
    return os.path.relpath(path, os.path.dirname(start) or ".").replace("\\", "/") if path else ""
