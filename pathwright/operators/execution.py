"""Running code in subprocesses of the workers. Code is not trusted: nothing runs unless the caller allows it."""

from __future__ import annotations

import os
import signal
import subprocess
import sys
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

COLUMNS = "exit_code int, timed_out boolean, stdout string, stderr string"


def _one(code: str | None, timeout: float) -> tuple[int, bool, str, str]:
    with tempfile.TemporaryDirectory() as folder:  # the worker's own; gone when the code has ended
        with open(os.path.join(folder, "answer.py"), "w", encoding="utf-8", errors="replace") as f:
            f.write(code or "")
        child = subprocess.Popen([sys.executable, "-I", "answer.py"], cwd=folder, env={"PATH": os.defpath, "HOME": folder, "PYTHONIOENCODING": "utf-8"}, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True)
        late = False
        try:
            out, err = child.communicate(timeout=timeout)
        except subprocess.TimeoutExpired:
            late = True
            os.killpg(child.pid, signal.SIGKILL)  # what the code started, too
            out, err = child.communicate()
        return (child.returncode, late, out.decode(errors="replace"), err.decode(errors="replace"))


def run(df: DataFrame, code: str = "code", timeout: float = 20.0, allow: bool = False) -> DataFrame:
    """df with exit_code, timed_out, stdout, stderr of its column code; null code is empty. Give the result to `verify.classify`."""
    if not allow:
        raise PermissionError("running code must be allowed")
    added = [c.split()[0] for c in COLUMNS.split(", ")]
    if clash := set(added) & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [_one(c, timeout) for c in frame[code]]
            yield frame.assign(**{name: [g[i] for g in got] for i, name in enumerate(added)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(batches, f"{fields}, {COLUMNS}")
