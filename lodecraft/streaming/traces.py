"""Trace events as a stream: resumable journals, running usage, windows over event time.

The journal and the usage counters are what recorded evaluations and traces need. Event-time windows and watermarks are
an extension of this library.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.traces import usage_columns
from ..sources import files
from ..storage import file_system


def read_events(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as they come."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def append_journal(stream: DataFrame, journal: str, checkpoint: str, keys: list[str], manifest: Mapping | None = None):
    """Append rows whose keys have not come before, then stop; started again, it goes on where it stopped.

    Which keys have come is the stream's own keyed state, so a micro-batch looks up its own keys and reads nothing of the journal, however long that has grown. Each batch is one folder,
    overwritten if the batch is run again after a failure. A journal belongs to one manifest (``sources.journal``) and to the checkpoint that began it: another
    manifest, or rows without their checkpoint, is an error.
    """
    spark = stream.sparkSession
    own, manifest = f"{journal}/run_manifest.json", files.plain({**(manifest or {}), "checkpoint": checkpoint, "keys": keys})
    if files.exists(spark, own):
        if files.read_json(spark, own) != manifest:
            raise ValueError(f"{journal} belongs to a run with another manifest or checkpoint")
        if not files.exists(spark, checkpoint) and files.exists(spark, f"{journal}/rows"):
            raise ValueError(f"{journal} has rows, but its checkpoint {checkpoint} is gone")
    else:
        system, where = file_system(spark, journal)
        system.mkdirs(where)
        files.write_json(spark, own, manifest)

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{journal}/rows/batch={number}")

    return stream.dropDuplicates(keys).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_journal(spark: SparkSession, journal: str, schema: StructType | str) -> DataFrame:
    """The journal's rows; no batch, no rows."""
    if not files.exists(spark, f"{journal}/rows"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{journal}/rows")
    return rows.drop("batch") if "batch" not in spark.createDataFrame([], schema).columns else rows


def running_usage(stream: DataFrame) -> DataFrame:
    """Usage of each trace so far; for update or complete mode."""
    return stream.groupBy("trace_id").agg(*[c.alias(n) for n, c in usage_columns().items()])


def windowed_counts(stream: DataFrame, time: str, late: str, size: str, slide: str | None, key: Column) -> DataFrame:
    """Counts by window and key; rows later than the watermark are dropped, closed windows are emitted once in append mode."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    counted = stream.withWatermark(time, late).groupBy(window.alias("w"), key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n")
