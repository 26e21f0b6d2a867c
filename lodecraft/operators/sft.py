"""Training records: behaviour labels, conversations, masks, padding, materialisation of solutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..storage import drop, materialise
from .skew import hot_limit, join_counted


def behaviour(tools: Column, invalid: Column) -> Column:
    """``recovery`` before ``python`` before ``sympy`` before ``direct``."""
    return F.when(invalid > 0, "recovery").when(F.array_contains(tools, "python"), "python").when(F.array_contains(tools, "sympy"), "sympy").otherwise("direct")


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, rendered, n): the messages of each conversation in order, as ``role: content`` blocks."""
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"))
    m = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("m"))
    return m.select("conv_id", F.array_join("m.line", "\n").alias("rendered"), F.size("m").cast("long").alias("n"))


def assistant_mask(sizes: Column, roles: Column) -> Column:
    """1 for each token of an assistant message and 0 for others, given the messages' token counts."""
    parts = F.transform(F.arrays_zip(sizes.alias("n"), roles.alias("r")), lambda x: F.array_repeat(F.when(x["r"] == "assistant", 1).otherwise(0), x["n"].cast("int")))
    return F.flatten(parts)


def pad_right(ids: Column, to: Column, pad: int = 0) -> Column:
    """``ids`` with ``pad`` up to ``to`` items; longer ones are an error, never cut."""
    checked = F.when(F.size(ids) > to, F.raise_error(F.lit("a sequence is longer than its batch")).cast("int")).otherwise(to)
    return F.concat(ids, F.array_repeat(F.lit(pad), checked - F.size(ids)))


def first_accepted(rows: DataFrame, key: str, order: Column, accepted: Column, batch: Column) -> DataFrame:
    """``outcome``: the first accepted row of a key by (batch, order) is ``accepted``, later accepted ones ``duplicate_task``, others ``rejected``.

    The first of a key is a min, combined before the shuffle; it goes back to the rows by a join that deals a key of many rows to several tasks. Rows that are
    first with equal batch and order are all accepted, so the order should be unique within a key. A null key is one key.
    """
    spark = rows.sparkSession
    marked = rows.withColumn("__own", F.struct(F.col(key))).withColumn("__place", F.struct(batch.alias("b"), order.alias("o"))).withColumn("__ok", F.coalesce(accepted, F.lit(False)))
    first = marked.groupBy("__own").agg(F.min(F.when(F.col("__ok"), F.col("__place"))).alias("__first"), F.count(F.lit(1)).alias("__n"))
    met = join_counted(marked, first, ["__own"], F.xxhash64("__place"), "__n", hot_limit(rows.count(), spark))
    outcome = F.when(~F.col("__ok"), "rejected").when(F.col("__place") == F.col("__first"), "accepted").otherwise("duplicate_task")
    return met.withColumn("outcome", outcome).drop("__own", "__place", "__ok", "__first", "__n")


class Batches:
    """Rows that come in batches, materialised one batch at a time under ``path``: of each task the first accepted row, by batch and then by order, is kept.

    ``add`` judges a batch by itself (``first_accepted``) and then against the accepted keys of earlier batches, of which it reads only the buckets that its own accepted keys fall in.
    So the outcome of every row is that of ``first_accepted`` over all rows with their batch numbers, while the work of a batch is bounded by the batch and those buckets. A batch is
    written once: numbers count up from 0, adding one that is there already does nothing, and a run that was cut short writes its batch again.
    Keys may be null; columns named ``bucket`` or ``batch`` may not be in the rows.
    """

    BUCKETS = 256

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, accepted: str):
        self.spark, self.path, self.key, self.order, self.accepted = spark, path.rstrip("/"), key, order, accepted

    def done(self) -> int:
        """Batches that are there in full."""
        n = 0
        while files.exists(self.spark, f"{self.path}/outcomes/batch={n}/_SUCCESS"):
            n += 1
        return n

    def _seen(self, buckets: list[int], before: int) -> DataFrame | None:
        folders = [f"{self.path}/accepted/batch={n}/bucket={b}" for n in range(before) for b in buckets]
        there = [f for f in folders if files.exists(self.spark, f)]
        return self.spark.read.parquet(*there).select(F.struct(self.key).alias("own"), F.lit(True).alias("__seen")) if there else None

    def add(self, rows: DataFrame, number: int) -> bool:
        """Whether the batch was new."""
        done = self.done()
        if number < done:
            return False
        if number > done:
            raise ValueError(f"batch {number} comes before batch {done}")
        judged = first_accepted(rows, self.key, F.col(self.order), F.col(self.accepted), F.lit(number))
        own = F.struct(self.key).alias("own")
        keys = judged.where("outcome = 'accepted'").select(own).withColumn("bucket", F.pmod(F.xxhash64("own"), F.lit(self.BUCKETS)).cast("int"))
        seen = self._seen([r.bucket for r in keys.select("bucket").distinct().collect()], number)
        if seen is not None:
            flags = keys.join(seen, "own").select("own", "__seen")
            late = F.col("__seen").isNotNull() & (F.col("outcome") == "accepted")
            judged = judged.withColumn("own", F.struct(self.key)).join(flags, "own", "left").withColumn("outcome", F.when(late, "duplicate_task").otherwise(F.col("outcome"))).drop("own", "__seen")
        target = f"{self.path}/outcomes/batch={number}"
        kept = materialise(judged, "outcomes")
        new = kept.where("outcome = 'accepted'").select(self.key).withColumn("bucket", F.pmod(F.xxhash64(F.struct(self.key)), F.lit(self.BUCKETS)).cast("int"))
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/accepted/batch={number}")
        kept.write.mode("overwrite").parquet(target)  # its mark comes last: the batch is there
        drop(self.spark, kept)
        return True

    def outcomes(self) -> DataFrame:
        """All rows with ``outcome`` and ``batch``."""
        return self.spark.read.option("basePath", f"{self.path}/outcomes").parquet(*[f"{self.path}/outcomes/batch={n}" for n in range(self.done())])
