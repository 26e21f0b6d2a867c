"""Progress of an evaluation that may be stopped and started again: rows added for good, bound to the manifest of the run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import file_system
from . import files

ARMS = ("base", "sft")


class Journal:
    """Rows (arm, task_id, ...) under ``path``; each batch is a folder that appears by one rename.

    Opening it with another manifest is an error, as is a row without a task id, of an unknown arm, or whose (arm, task_id) the batch or
    the journal has already. A batch with any such row adds nothing. A batch number that is there already was added before a restart: adding it
    again does nothing. One writer at a time; readers see whole batches.
    """

    def __init__(self, spark: SparkSession, path: str, manifest: Mapping, schema: StructType | str, arms: tuple[str, ...] = ARMS):
        self.spark, self.path, self.arms = spark, path.rstrip("/"), arms
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        own, manifest = f"{self.path}/run_manifest.json", files.plain(dict(manifest))
        if files.exists(spark, own):
            if files.read_json(spark, own) != manifest:
                raise ValueError(f"{path} belongs to a run with another manifest")
        elif files.exists(spark, self.path):
            raise ValueError(f"{path} is there but holds no journal")
        else:
            system, where = file_system(spark, self.path)
            system.mkdirs(where)
            files.write_json(spark, own, manifest)

    def _batches(self) -> list[str]:
        system, where = file_system(self.spark, f"{self.path}/batch=*")
        return [s.getPath().toString() for s in system.globStatus(where)]

    def rows(self) -> DataFrame:
        found = self._batches()
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def progress(self) -> dict[str, int]:
        counted = {r["arm"]: r["n"] for r in self.rows().groupBy("arm").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {a: counted.get(a, 0) for a in self.arms}

    def pending(self, tasks: DataFrame) -> DataFrame:
        """Rows of ``tasks`` (arm, task_id, ...) that the journal does not hold."""
        return tasks.join(self.rows().select("arm", "task_id"), ["arm", "task_id"], "left_anti")

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Add a batch; whether it was new. The batch is written once, checked as written, and renamed into place."""
        target, staged = f"{self.path}/batch={batch:012d}", f"{self.path}/_staged-{batch:012d}"
        if files.exists(self.spark, target):
            return False
        rows.select(*self.schema.names).write.mode("overwrite").parquet(staged)
        new = self.spark.read.schema(self.schema).parquet(staged)
        try:
            self._check(new)
            files.rename(self.spark, staged, target)
        finally:
            system, where = file_system(self.spark, staged)
            if system.exists(where):
                system.delete(where, True)
        return True

    def _check(self, new: DataFrame) -> None:
        bad = new.where(F.col("task_id").isNull() | (F.col("task_id").cast("string") == "") | F.col("arm").isNull() | ~F.col("arm").isin(*self.arms)).first()
        if bad:
            raise ValueError(f"a row without a task id or of an unknown arm: {bad.asDict()}")
        keys = new.groupBy("arm", "task_id").agg(F.count(F.lit(1)).alias("n"))
        twice = keys.where("n > 1").first() or keys.join(self.rows().select("arm", "task_id"), ["arm", "task_id"], "left_semi").first()
        if twice:
            raise ValueError(f"{twice['arm']}:{twice['task_id']} is there twice")
