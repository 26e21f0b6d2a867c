"""Row numbers within groups of which one may hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 512


def group_ranks(df: DataFrame, groups: Sequence[str], order: Sequence[Column], out: str, salts: int = SALTS, labels: DataFrame | None = None) -> DataFrame:
    """``df`` with ``out``: 0-based, gapless, unique rank of each row in its group (long).

    Rows are dealt by (group, hash of the order columns), so a group that holds most rows is numbered by
    ``salts`` independent windows; a small table of (group, salt) counts gives each window its first rank.
    The rank order is (salt, order): a fixed pseudo-random order that depends on the rows' values alone.
    Rows equal in every order column get consecutive ranks. Groups may be null. ``labels`` has one row for each group: its
    other columns are added to the group's rows by way of the small table of counts, so a group that holds most rows is not joined as one.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    keyed = df.withColumn("__key", F.struct(*[F.col(g) for g in groups], salt.alias("__salt")))  # structs equal with nulls inside
    counts = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    in_group = Window.partitionBy(*[F.col(f"__key.{g}") for g in groups]).orderBy("__key.__salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("__key").alias("__of"), F.coalesce(F.sum("__n").over(in_group), F.lit(0)).alias("__first"))
    carried = []
    if labels is not None:
        carried = [c for c in labels.columns if c not in groups]
        same = [F.col(f"__of.{g}").eqNullSafe(F.col(f"__label.{g}")) for g in groups]
        named = labels.select(F.struct(*labels.columns).alias("__label"))
        first = first.join(named, same).select("__of", "__first", *[F.col(f"__label.{c}").alias(c) for c in carried])
    own = F.row_number().over(Window.partitionBy("__key").orderBy(*order)).cast("long") - 1
    numbered = keyed.withColumn("__own", own)  # dealt by the key, which the join keeps: rows move once
    joined = numbered.join(first, F.col("__key") == F.col("__of"))  # keeps the columns of ``labels``
    return joined.withColumn(out, F.col("__own") + F.col("__first")).drop("__key", "__own", "__of", "__first")
