"""The corpus pipeline: language, near-duplicates, benchmark passages, personal data, mixture; each stage's output is a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwright.llm import decontamination, language_id, mixing, personal_data, simhash
from pathwright.llm.common import drop_table, load, temporary_tables


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows and is fairly sure of; a null, empty or letterless text has none and goes. Repeated rows share their fate."""
    return language_id.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, that of the smallest doc_id. Null and wordless texts are a group; a row without a doc_id stays only if no row of its group has one."""
    return simhash.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window. A null text holds none and stays, whatever its doc_id."""
    return decontamination.clean_only(docs, load(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by their kinds in brackets and n_chars counted anew (null for a null text)."""
    return personal_data.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a rate above 0, their rate, and the share by which the mixture misses its targets; a null text counts as empty. Rows that are alike get one rate."""
    return mixing.mixed(docs, load(spark, sf_dir, "labels"), tell=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("private", private), ("mixture", mixture)]

#: The stages learn models and follow links over many steps, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages, as a table; tables of earlier stages are deleted once the next one's is written."""
    docs, last = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with temporary_tables(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            drop_table(last)
        last = docs
    return docs
