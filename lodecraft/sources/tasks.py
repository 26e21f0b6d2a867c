"""The task table at rest: ten columns, written sorted, with digests; quarantine and pools as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import require_columns

COLUMNS = ("task_id", "problem", "answer_type", "dataset", "split", "source_hash", "pipeline_version", "metadata", "reference_value", "reference_acceptable_forms")


def flatten(tasks: DataFrame, answer_type: str = "integer", split: str = "unassigned") -> DataFrame:
    """Kept tasks as rows of the table."""
    return tasks.select("task_id", "problem", F.lit(answer_type).alias("answer_type"), "dataset", F.lit(split).alias("split"), "source_hash", F.lit("canonicalize-v1").alias("pipeline_version"), F.lit("{}").alias("metadata"), F.col("answer").alias("reference_value"), F.array().cast("array<string>").alias("reference_acceptable_forms"))


def acceptable_forms(raw: Column) -> Column:
    """JSON null, a string or a list of strings as a list."""
    return F.when(raw.isNull() | (raw == "null"), F.array().cast("array<string>")).when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]))


def write_tasks(tasks: DataFrame, path: str) -> None:
    """Range-partitioned and sorted by id, so readers prune files by id; refuses a folder that is there."""
    require_columns(tasks, list(COLUMNS)).select(*COLUMNS).repartitionByRange("task_id").sortWithinPartitions("task_id").write.mode("errorifexists").option("compression", "zstd").parquet(path)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), list(COLUMNS), exact=True)


def write_quarantine(records: DataFrame, path: str) -> None:
    records.select("source", "source_hash", "reason").write.mode("errorifexists").json(path)


def write_pool(pool: DataFrame, path: str) -> None:
    """One JSON object a line."""
    pool.select("value").write.mode("errorifexists").text(path)
