"""The generator as a source of Spark: `spark.read.format("pathwright_instances")`, planned by ranges of seeds.

Options: start and end (seeds from start to before end), partitions, families (comma-separated; all if left out), pushdown. Rows are those of
`instances.long` for the same seeds. Each partition works from its own range alone, in numpy. With pushdown `true`, which needs a session that
lets Python sources see filters (spark.sql.python.filterPushdown.enabled), bounds of the seed narrow the ranges, and families that are not asked for are not made."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from ..operators import instances as I
from . import extension

NAME = "pathwright_instances"
SCHEMA = "seed long, template_name string, field string, i long, j long, value long"
#: Seeds that a task works on at once.
LOT = 8192


def draw(seed: np.ndarray, salt: np.ndarray | int, low: int, high: int) -> np.ndarray:
    """instances.draw in numpy: remainders have the sign of the dividend, as the engine's have."""
    mixed = np.fmod(np.fmod(seed, 2147483648) * 1103515245 + np.int64(1) * salt * 12820163 + 12345, 2147483648)
    mixed = np.fmod(np.fmod(mixed * 69069 + 907633385, 2147483648) * 1664525 + 1013904223, 2147483648)
    return low + np.fmod(mixed // 4096, high - low + 1)


def _numbers(seed: np.ndarray, family: str) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """field, seed, i, j, value of the seeds of one family."""
    low, high = I.SIZES[family]
    n, at = draw(seed, I.SIZE, low, high), np.arange(high)
    held = at < n[:, None]
    where, i = np.nonzero(held)
    facts = {name: draw(seed[:, None], I.FACT + 8 * f + at, *b) * held for f, (name, b) in enumerate(I.FACTS[family].items())}
    for name, values in facts.items():
        yield name, seed[where], i, np.zeros_like(i), values[held]
    totals = None
    if family in I.CELLS:
        rows = draw(seed, I.RESOURCE_COUNT, 2, 3) if family == "resource_allocation" else n
        r, c = np.meshgrid(np.arange(rows.max()), at, indexing="ij")
        salt = np.minimum(r, c) * 8 + np.maximum(r, c) if family == "tsp" else r * 8 + c
        cells = draw(seed[:, None, None], I.CELL + salt, *I.CELLS[family])
        if family == "tsp":
            cells = np.where(r == c, 0, cells)
        inside = (r < rows[:, None, None]) & (c < n[:, None, None])
        where, i, j = np.nonzero(inside)
        yield "cell", seed[where], i, j, cells[inside]
        if family == "resource_allocation":
            totals, kept = (cells * inside).sum(axis=2), np.arange(rows.max()) < rows[:, None]
    elif family == "production_planning":
        totals = (facts["max_units"] * facts["labor_hours"]).sum(axis=1)[:, None]
    else:
        totals = facts["weight"].sum(axis=1)[:, None]
    if totals is not None:
        kept = kept if family == "resource_allocation" else np.ones_like(totals, bool)
        limits = totals * draw(seed[:, None], I.LIMIT + np.arange(totals.shape[1]), *I.LIMITS[family]) // 1000
        where, i = np.nonzero(kept)
        yield "limit", seed[where], i, np.zeros_like(i), limits[kept]


@dataclass
class Seeds(ds.InputPartition):
    start: int
    end: int


class Reader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.start, self.end = int(options.get("start", 0)), int(options.get("end", 0))
        self.parts = max(1, int(options.get("partitions", 8)))
        asked = options.get("families")
        self.families = [f for f in I.POOLS if asked is None or f in asked.split(",")]

    def partitions(self) -> list[ds.InputPartition]:
        n = max(0, self.end - self.start)
        parts = min(self.parts, max(1, n))
        return [Seeds(self.start + n * k // parts, self.start + n * (k + 1) // parts) for k in range(parts)]

    def read(self, partition: Seeds) -> Iterator[pa.RecordBatch]:
        names = list(I.POOLS)
        for low in range(partition.start, partition.end, LOT):
            seed = np.arange(low, min(low + LOT, partition.end), dtype=np.int64)
            drawn = np.maximum(0, draw(seed, I.TEMPLATE, 0, len(names) - 1))
            for family in self.families:
                own = seed[drawn == names.index(family)]
                for field, s, i, j, v in _numbers(own, family) if len(own) else ():
                    same = lambda x: pa.array([x]).take(pa.array(np.zeros(len(s), np.int32)))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([pa.array(s), same(family), same(field), pa.array(i), pa.array(j), pa.array(v)], names=["seed", "template_name", "field", "i", "j", "value"])


class PushingReader(Reader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f: ds.Filter) -> bool:
        column = getattr(f, "attribute", None)
        if column == ("seed",) and isinstance(f, ds.EqualTo | ds.GreaterThan | ds.GreaterThanOrEqual | ds.LessThan | ds.LessThanOrEqual):
            if isinstance(f, ds.EqualTo | ds.GreaterThan | ds.GreaterThanOrEqual):
                self.start = max(self.start, f.value + isinstance(f, ds.GreaterThan))
            if isinstance(f, ds.EqualTo | ds.LessThan | ds.LessThanOrEqual):
                self.end = min(self.end, f.value + (not isinstance(f, ds.LessThan)))
            return True
        if column == ("template_name",) and isinstance(f, ds.EqualTo | ds.In):
            asked = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
            self.families = [x for x in self.families if x in asked]
            return True
        return isinstance(f, ds.IsNotNull) and column in (("seed",), ("template_name",))


class Instances(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return PushingReader(self.options) if self.options.get("pushdown", "false") == "true" else Reader(self.options)


def register(spark: SparkSession) -> None:
    extension.register(spark, Instances)
