"""Joins of a table in which one key may hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import parallelism

#: Rows of one key that a task takes in any case.
FLOOR = 256


def hot_limit(total: int, spark: SparkSession) -> int | None:
    """Rows of one key above which it is split, for a table of ``total`` rows: at most 8 keys a shuffle partition are over it. None: no key can be."""
    return None if total <= FLOOR else max(FLOOR, -(-total // (8 * parallelism(spark))))


def join_counted(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Column, n: str, limit: int | None, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has one row for each of ``keys``; keys with more than ``limit`` rows on the left are split.

    ``right[n]`` is the number of left rows of its key, or more. A key over the limit is dealt into parts of about ``limit`` rows by the
    hash of ``spread``, which should differ between its rows; its right row is copied to each. The keys that are split go
    to every executor: with a limit from ``hot_limit`` they are at most 8 a shuffle partition, however large the tables.
    ``how`` is inner or left. Null keys match nothing. ``n`` is a column of the result; neither side may have one named ``__part`` or ``__parts``.
    """
    if limit is None:
        return left.join(right, list(keys), how)
    parts = F.ceil(F.col(n) / F.lit(limit))
    hot = right.where(F.col(n) > limit).select(*keys, parts.alias("__parts"))
    dealt = left.join(F.broadcast(hot), list(keys), "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__parts")), F.lit(0).cast("long"))).drop("__parts")
    last = F.when(F.col(n) > limit, parts - 1).otherwise(0).cast("long")
    copied = right.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return dealt.join(copied, [*keys, "__part"], how).drop("__part")
