"""What the training-data operators share: the shared folder, tables written there, scans in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.jsonl import scratch

#: Rows and bytes that a scan takes at once, of a batch as Spark hands it over (whose size the session's own settings bound).
SLICE_ROWS = 256
SLICE_BYTES = 16 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, and of fewer where rows are long on average."""
    for batch in batches:
        n = min(rows, max(1, int(SLICE_BYTES * batch.num_rows / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


#: Paths given out, in order.
_GIVEN: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (see sources.jsonl.scratch)."""
    _GIVEN.append(scratch(spark, name))
    return _GIVEN[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a written() table that nothing reads any more."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        delete(df.sparkSession, path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes, at the end, what was written meanwhile. The function given writes a table that stays."""
    first, kept = len(_GIVEN), set()

    def keep(df: DataFrame, name: str) -> DataFrame:
        at = len(_GIVEN)
        out = written(df, name)
        kept.add(_GIVEN[at])
        return out

    yield keep
    for path in _GIVEN[first:]:
        if path not in kept:
            delete(spark, path)
    _GIVEN[first:] = [p for p in _GIVEN[first:] if p in kept]


Scan = Callable[[list], list[pa.Array]]


def append_scan(df: DataFrame, column: str, fields: list[T.StructField], factory: Callable[[], Scan]) -> DataFrame:
    """df with `fields` appended. factory() gives, once for each task, the function from a slice of `column` to the new arrays.

    The new names must not be in df; callers use names of their own (see fresh())."""
    place = df.columns.index(column)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = factory()
        for batch in slices(batches):
            new = scan(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it if df has such a column (whatever the case of its letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_bucket(column: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def let(x: F.Column, body: Callable[[F.Column], F.Column]) -> F.Column:
    """body(x) with x evaluated once, however often body uses it and wherever the optimiser moves it."""
    return F.transform(F.array(x), body)[0]


class Numbering(dict):
    """Numbers its keys as they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n
