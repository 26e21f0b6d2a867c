"""Exact quantiles of groups of any size, by narrowing ranges instead of gathering values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import drop, materialise
from .skew import hot_limit, join_counted

#: Parts that a range is cut into each round.
PARTS = 1024


def quantiles(rows: DataFrame, groups: Sequence[str], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """``groups`` and a double for each entry ``name: (column, q)`` of ``wanted``: the linearly interpolated quantile, as ``percentile`` gives it.

    With n values the quantile lies at place (n - 1) * q of their order, between its two neighbours. Each needed place has a range of values that holds it, at first all.
    A round cuts ranges into ``PARTS`` by width and counts the rows, with least and greatest value, of each part, combined before the shuffle; the part that holds the place is the next
    range, until it is one value. So a round moves at most ``PARTS`` rows for each place and task, no group is gathered or sorted, and values spread evenly need about log n / log PARTS rounds
    (each 1024-fold in scale of very uneven ones needs one more). A group that holds most rows is dealt to several tasks.

    Null and NaN values are left out; a group without values has nulls. Groups may be null. No rows: no rows.
    """
    spark = rows.sparkSession
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    long = F.explode(F.array(*[F.struct(F.lit(i).alias("of"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]))
    keyed = rows.select(F.struct(*groups).alias("own"), long.alias("x")).select(F.struct("own", "x.of").alias("g"), "x.v")
    every = materialise(keyed, "values")
    values = every.where("v is not null and not isnan(v)")
    sizes = values.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    places = F.flatten(F.array(*[F.when(F.col("g.of") == columns.index(c), F.array(F.floor((F.col("n") - 1) * q), F.ceil((F.col("n") - 1) * q))).otherwise(F.array().cast("array<bigint>")) for c, q in wanted.values()]))
    targets = materialise(sizes.select("g", "n", F.explode(F.array_distinct(places)).alias("k"), F.lit(0).cast("long").alias("before"), "lo", "hi"), "places")
    limit = hot_limit(values.count(), spark)
    while not targets.where("lo < hi").isEmpty():
        open_ = targets.where("lo < hi").groupBy("g").agg(F.max("n").alias("n"), F.collect_list(F.struct("k", "before", "lo", "hi")).alias("t"))  # at most two a quantile
        met = join_counted(values, open_, ["g"], F.col("v"), "n", limit).select("g", "v", F.explode("t").alias("t")).where(F.col("v").between(F.col("t.lo"), F.col("t.hi")))
        share = (F.col("v") / 2 - F.col("t.lo") / 2) / (F.col("t.hi") / 2 - F.col("t.lo") / 2)
        part = F.least(F.floor(share * PARTS), F.lit(PARTS - 1))
        counted = met.groupBy("g", F.col("t.k").alias("k"), F.col("t.before").alias("before"), part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy("g", "k").orderBy("part"))
        found = counted.withColumn("upto", F.col("before") + upto).where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("c")))
        found = found.join(targets.select("g", "k", "n"), ["g", "k"]).select("g", "n", "k", (F.col("upto") - F.col("c")).alias("before"), "lo", "hi")
        targets, last = materialise(targets.where("lo = hi").unionByName(found), "places"), targets
        drop(spark, last)
    held = targets.groupBy("g").agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("k", "lo"))).alias("at"))
    held = held.groupBy("g.own").agg(F.map_from_entries(F.collect_list(F.struct("g.of", F.struct("n", "at").alias("s")))).alias("s"))
    out = []
    for name, (c, q) in wanted.items():
        s = F.try_element_at("s", F.lit(columns.index(c)))
        place = (s["n"] - 1) * q
        low, high = (s["at"][f(place)] for f in (F.floor, F.ceil))
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    all_groups = every.select("g.own").distinct()
    same = F.col("a.own").eqNullSafe(F.col("b.own"))
    return all_groups.alias("a").join(held.alias("b"), same, "left").select("a.own.*", *out)
