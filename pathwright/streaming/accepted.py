"""Accept until a target, over a stream of attempts that come in any order within the watermark.

Each run keeps in its state how many attempts it has accepted and, by event time, the attempts that may still be preceded by others. When the
watermark passes a time, a timer lets out that time's attempts in the order of seed, variant and trajectory; the running count ends with
the target-th success, and what comes later is neither kept nor counted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "run string, seed long, variant int, traj int, success boolean, accepted long"
_WAITING = "seed long, variant int, traj int, success boolean"


class Accept(StatefulProcessor):
    def __init__(self, target: int):
        self.target = target

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getValueState("accepted", "n long")
        self.waiting = handle.getMapState("waiting", "at long, " + ", ".join(f"k{i} {t}" for i, t in enumerate(("long", "int", "int"))), "success boolean")

    def _count(self) -> int:
        return self.accepted.get()[0] if self.accepted.exists() else 0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self._count() < self.target:
            times = set()
            for frame in rows:
                at = frame["at"].astype("datetime64[ms]").astype("int64")
                for when, seed, variant, traj, success in zip(at, frame["seed"], frame["variant"], frame["traj"], frame["success"], strict=True):
                    self.waiting.updateValue((int(when), int(seed), int(variant), int(traj)), (bool(success),))
                    times.add(int(when))
            for when in times:
                self.handle.registerTimer(when)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        count, now, out = self._count(), expiredTimerInfo.getExpiryTimeInMs(), []
        if count < self.target:
            # an earlier time's own timer may come after this one
            ready = sorted((tuple(k), v[0]) for k, v in self.waiting.iterator() if k[0] <= now)
            for place, success in ready:
                self.waiting.removeKey(place)
                if count < self.target:
                    count += success
                    out.append((*key, *place[1:], success, count))
            self.accepted.update((count,))
            if count >= self.target:
                self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def until_target(attempts: DataFrame, target: int, delay: str) -> DataFrame:
    """run, seed, variant, traj, success, accepted of each run's attempts (run, at, seed, variant, traj, success) up to and with its target-th
    success. `at` must not fall as seeds rise; an attempt that comes more than `delay` after a later one is lost. The session's state
    store must be RocksDB's. Append mode: an attempt comes out once the watermark has passed its time."""
    return attempts.withWatermark("at", delay).groupBy("run").transformWithStateInPandas(Accept(target), SCHEMA, "Append", "EventTime")
