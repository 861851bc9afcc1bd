"""Folders and report files of one training run. A run's log is small and lies with the driver; its figures are those of operators.history."""

from __future__ import annotations

import time
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .. import config
from ..operators import history as H
from .files import write_json

#: Folders below a run's, by what they are for.
LAYOUT = {"run_dir": "", "weights_dir": "weights", "metrics_dir": "metrics", "checkpoints_dir": "weights/checkpoints", "final_dir": "weights/final_adapter"}


def folders(output_dir: str, run_root: str | None = None, run_prefix: str = "train") -> dict[str, str]:
    """A new run's folders below run_root, which is the output folder's name with `_runs` where none is given."""
    root = config.mapped(run_root) if run_root else config.mapped(output_dir) + "_runs"
    run = Path(root, f"{run_prefix}_{time.strftime('%Y%m%d_%H%M%S')}")
    made = {name: run / below for name, below in LAYOUT.items()}
    for path in made.values():
        path.mkdir(parents=True, exist_ok=True)
    return {name: str(path) for name, path in made.items()}


def log(spark: SparkSession, rows: list[Any]) -> DataFrame:
    """A log's rows in the columns of operators.history, as they are in place of whole numbers. What is no object is left out; a missing value is null."""
    fields = {"loss": "loss_c", "learning_rate": "lr_e9", "epoch": "epoch_c"} | {m: f"{m}_c" for m in H.METRICS}
    number = lambda r, k, kind: None if r.get(k) is None else kind(r[k])
    values = [(i, number(r, "step", int), *[number(r, k, float) for k in fields]) for i, r in enumerate(rows) if isinstance(r, dict)]
    return spark.createDataFrame(values, "pos long, step long, " + ", ".join(f"{c} double" for c in fields.values()))


def summarize(spark: SparkSession, rows: list[Any], train_metrics: dict[str, Any] | None = None, stage_name: str = "training") -> dict[str, Any]:
    """A log's figures by name. Without a log point only the stage, the number of points (0) and the trainer's metrics."""
    history = log(spark, rows)
    found = {c.removesuffix("_c"): v for c, v in H.summary(history).first().asDict().items()}
    n = found.pop("num_log_points")
    out = {"stage_name": stage_name, "num_log_points": n} | ({"train_metrics": train_metrics} if train_metrics else {})
    if not n:
        return out
    found["final_learning_rate"] = found.pop("final_lr_e9")
    if history.where("loss_c IS NOT NULL AND step IS NOT NULL").selectExpr("max_by(struct(epoch_c), pos).epoch_c").first()[0] is None:
        found["final_epoch"] = float((train_metrics or {}).get("epoch") or 0.0)  # the trainer's, if the last point has none
    per = {r["metric"]: r for r in H.first_last_best(history).collect()}  # one row a metric
    return out | found | {f"{end}_{m}": per[m][f"{end}_value"] for m in H.METRICS if m in per for end in ("first", "last", "best")}


def report(metrics_dir: str, summary: dict[str, Any], rows: list[Any], settings: dict[str, Any] | None = None) -> dict[str, str]:
    """Writes summary, log and, if given, the run's settings as JSON; gives the paths by name. There is no image: operators.history.series has what it shows."""
    files = {"summary_path": ("summary.json", summary), "log_history_path": ("log_history.json", {"log_history": rows})}
    if settings is not None:
        files["config_path"] = ("config_snapshot.json", settings)
    for name, value in files.values():
        write_json(f"{metrics_dir}/{name}", value)
    return {key: f"{metrics_dir}/{name}" for key, (name, _) in files.items()}
