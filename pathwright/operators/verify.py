"""Classification of recorded executions against a reference objective."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.results import result_of
from ..functions.text import last_marker

TOLERANCE = 1e-4


def classify(executions: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """executions (exit_code, timed_out, stdout, reference_objective) with execution_ok, status, objective_value, objective_match and success. First rule that holds: timeout, exit code, no marker line, no object, else the object's status."""
    df = executions.withColumn("_payload", F.when(~F.col("timed_out") & (F.col("exit_code") == 0), last_marker(F.col("stdout"))))
    df = df.withColumn("_result", result_of(F.col("_payload")))
    status = F.when(F.col("timed_out"), "TIMEOUT").when(F.col("exit_code") != 0, "RUNTIME_ERROR").when(F.col("_payload").isNull(), "MISSING_RESULT").when(F.col("_result.ok").isNull(), "INVALID_RESULT").otherwise(F.col("_result.status"))
    df = df.withColumns({"execution_ok": F.col("_payload").isNotNull(), "status": status, "objective_value": F.col("_result.objective_value")})
    df = df.withColumn("objective_match", F.coalesce(F.abs(F.col("objective_value") - F.col("reference_objective")) <= tolerance, F.lit(False)))
    return df.withColumn("success", (F.col("status") == "OPTIMAL") & F.col("objective_match")).drop("_payload", "_result")
