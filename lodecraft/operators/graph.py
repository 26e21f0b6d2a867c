"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, materialise
from .skew import hot_limit, join_counted


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): every id that has a link, with the smallest id it can reach.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the links no longer change: each step is a min
    aggregate per node, combined before the shuffle, and a join in which a hub's links are dealt to several tasks.
    Null ends and links of an id with itself are no links. The table of each step is written to shared storage, and deleted after the next.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a) != F.col(b))).distinct()
    edges = materialise(edges, "links")
    stamp, last = _stamp(edges), None
    while stamp[0] and stamp != last:
        limit = hot_limit(2 * stamp[0], spark)
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
        large = join_counted(both, least, ["u"], F.col("v"), "n", limit).where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
        large = materialise(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        drop(spark, edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_counted(large, least, ["u"], F.col("v"), "n", limit)
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialise(small.select("e.u", "e.v").where("u != v").distinct(), "links")
        drop(spark, large)
        stamp, last = _stamp(edges), stamp
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
