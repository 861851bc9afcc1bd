"""Result lines: what a payload says of status and objective, as Python reads it.

A payload is an object in JSON (not-a-number and infinities included) or, failing that, a Python dict literal. Flat JSON objects,
which nearly all payloads are, are read by the engine; only the others go through Python, in Arrow batches."""

from __future__ import annotations

import ast
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_NUMBER = r"-?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]{1,15})?(?:[eE][-+]?[0-9]{1,2})?"
_FLAT = rf'^\{{\s*+(?:"[ !#-\[\]-~]*+"\s*+:\s*+(?:"[ !#-\[\]-~]*+"|{_NUMBER}|null|true|false)\s*+(?:,\s*+(?=")|(?=\}})))*+\}}$'
_PLAIN_NUMBER = r"^\s*[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\s*$"
KIND = "struct<ok: boolean, status: string, objective_value: string>"


def read_object(text: str) -> dict | None:
    """The object that a payload holds; None if it holds none."""
    for read in (json.loads, ast.literal_eval):
        try:
            got = read(text.strip())
        except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
            continue
        if isinstance(got, dict):
            return got
    return None


def status_of(value: object) -> str:
    """Numbers (and true, false) are whole numbers as text, 0 being OPTIMAL; other values their text, the two known words in capitals."""
    if isinstance(value, int | float) and math.isfinite(value):
        return "OPTIMAL" if int(value) == 0 else str(int(value))
    text = str(value).strip()
    return text.upper() if text.upper() in ("OPTIMAL", "FEASIBLE") else text


def objective_of(value: object) -> float | None:
    try:
        return None if value is None else float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return None


def in_python(payloads: pd.Series) -> pd.DataFrame:
    rows = []
    for text in payloads:
        got = None if text is None else read_object(text)
        rows.append((None, None, None) if got is None else (True, status_of(got.get("status", "UNKNOWN")), None if (x := objective_of(got.get("objective_value"))) is None else repr(x)))
    return pd.DataFrame(rows, columns=["ok", "status", "objective_value"])


def _in_engine(payload: Column) -> tuple[Column, Column, Column]:
    """(whether the engine reads this payload as Python does, status, objective)."""
    v = F.try_parse_json(payload)  # null where a key is repeated
    at = lambda field: F.try_variant_get(v, f"$.{field}", "variant")
    kind, text = F.schema_of_variant(at("status")), strip(F.try_variant_get(v, "$.status", "string"))
    number = F.try_variant_get(v, "$.status", "double")
    status = (
        F.when(kind.isNull(), "UNKNOWN")
        .when(kind == "VOID", "None")
        .when(kind == "STRING", F.when(F.upper(text).isin("OPTIMAL", "FEASIBLE"), F.upper(text)).otherwise(text))
        .when(kind == "BOOLEAN", F.when(text == "true", "1").otherwise("OPTIMAL"))
        .otherwise(F.when(number.cast("bigint") == 0, "OPTIMAL").otherwise(number.cast("bigint").cast("string")))
    )
    given, said = F.schema_of_variant(at("objective_value")), F.try_variant_get(v, "$.objective_value", "string")
    objective = F.when(given == "BOOLEAN", F.when(said == "true", 1.0).otherwise(0.0)).when(given != "VOID", said.try_cast("double"))
    whole = kind.isNull() | kind.isin("VOID", "STRING", "BOOLEAN") | (F.abs(number) < 2**53)
    readable = given.isNull() | (given != "STRING") | said.rlike(_PLAIN_NUMBER)
    return F.coalesce(payload.rlike(_FLAT) & v.isNotNull() & whole & readable, F.lit(False)), status, objective


def result_of(payload: Column) -> Column:
    """struct<ok, status, objective_value> of a payload; ok is true for an object and null for anything else."""
    engine, status, objective = _in_engine(payload)
    python = F.pandas_udf(in_python, KIND)(F.when(~engine, payload))
    own = F.struct(F.lit(True).alias("ok"), status.alias("status"), objective.alias("objective_value"))
    read = F.when(python["ok"], F.struct(python["ok"].alias("ok"), python["status"].alias("status"), python["objective_value"].cast("double").alias("objective_value")))
    return F.when(engine, own).otherwise(read)


def is_object(payload: Column) -> Column:
    """Whether a payload holds an object."""
    return F.coalesce(result_of(payload)["ok"], F.lit(False))
