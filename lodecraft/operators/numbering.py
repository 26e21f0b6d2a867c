"""Global row numbers without a single-partition sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, bucket: Column, order: Sequence[Column], out: str, groups: Sequence[str] = ()) -> DataFrame:
    """``out``: the 1-based row number (long) by ``order``, within ``groups`` if any.

    ``bucket`` must not decrease along ``order`` (a prefix of the first key, or its quotient). Rows are sorted within
    buckets only; one small table of bucket counts gives each bucket the number of rows before it.
    """
    marked = df.withColumn("__bucket", bucket)
    counts = marked.groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy(*groups, "__bucket").orderBy(*order))
    numbered = marked.withColumn("__own", own)
    return numbered.join(starts, [*groups, "__bucket"]).withColumn(out, (F.col("__own") + F.col("__before")).cast("long")).drop("__bucket", "__own", "__before")
