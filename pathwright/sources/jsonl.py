"""JSON lines: strict reading with a declared schema and required fields, writing with nulls kept."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a file or folder; blank lines do not count, malformed ones and nulls in required fields raise an error."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for name in required:
        df = df.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"no {name}"))).otherwise(F.col(name)))
    return df


#: Where a row of `read_in_order` comes from: its file, and its place there.
ORDER = ("_file", "_block", "_line")


def read_in_order(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """read(), with the columns ORDER by which rows stand as in their files. A large file is read in blocks by several tasks; lines are numbered within a block."""
    df = read(spark, path, schema, required)
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))


def write(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A folder of JSON lines; with order, sorted over all its parts by range, not in one task."""
    df = df.orderBy(*order) if order else df
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the application's file systems are closed."""
    return f"{_session_folder(spark.sparkContext.applicationId, _shared_folder(spark))}/{name}-{uuid.uuid4().hex}"


def _shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a folder of this process, which only a local run can share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    return "file://" + _own_folder()


@functools.cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="pathwright-")
    atexit.register(shutil.rmtree, path, True)
    return path


@functools.cache
def _session_folder(application: str, base: str) -> str:
    path = f"{base}/pathwright-{uuid.uuid4().hex}"
    spark = SparkSession.active()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path
