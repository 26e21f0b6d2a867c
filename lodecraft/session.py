"""Sessions, and what every query needs of one."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", app: str = "lodecraft", **conf: str) -> SparkSession:
    """A session with this library's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


#: Bytes of a batch that goes to a Python worker, where Spark's own limit (64 MB) holds: both sides keep a few batches for each task.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 8 << 20)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it is not installed (local runs, tests), and give them batches of bounded size."""
    name, usual, ours = BATCH
    if spark.conf.get(name).removesuffix("b") == str(usual):
        spark.conf.set(name, str(ours))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark
