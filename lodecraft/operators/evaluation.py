"""Paired evaluation: arm summaries, outcomes, bootstrap intervals, McNemar's exact test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles

# Statuses, and resamples with the order statistics of a 95 % interval.
STATUSES = ("correct", "incorrect", "invalid_prediction", "invalid_reference", "timeout", "internal_error")
RESAMPLES = 10_000


def arm_summary(rows: DataFrame) -> DataFrame:
    """Counts by status, accuracy, token and latency statistics of each arm; a batch's time counts once."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    main = rows.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), *counts, F.round(F.avg(F.col("correct").cast("double")), 9).alias("accuracy"), F.round(F.count_if(F.col("status").isin("correct", "incorrect")) / F.count(F.lit(1)), 9).alias("valid_rate"), F.round(F.avg("output_tokens"), 9).alias("mean_tokens"), F.sum("output_tokens").cast("long").alias("tokens"))
    places = quantiles(rows, ["arm"], {"median_tokens": ("output_tokens", 0.5), "p50_ms": ("latency_ms", 0.5), "p95_ms": ("latency_ms", 0.95)})
    batches = rows.groupBy("arm", "batch").agg(F.max("latency_ms").alias("ms")).groupBy("arm").agg(F.round(F.sum("ms") / 1000, 6).alias("elapsed_s"))
    out = main.join(places, "arm").join(batches, "arm").withColumn("tokens_per_s", F.round(F.col("tokens") / F.col("elapsed_s"), 6))
    return out.withColumns({c: F.round(c, 9) for c in ("p50_ms", "p95_ms")})


def paired(rows: DataFrame) -> DataFrame:
    """(task_id, base, sft, outcome): both arms of a task side by side, by one aggregate."""
    wide = rows.groupBy("task_id").agg(F.bool_or(F.when(F.col("arm") == "base", F.col("correct"))).alias("base"), F.bool_or(F.when(F.col("arm") == "sft", F.col("correct"))).alias("sft"))
    outcome = F.when(F.col("sft") & ~F.col("base"), "improved").when(F.col("base") & ~F.col("sft"), "regressed").otherwise("unchanged")
    return wide.where("base is not null and sft is not null").withColumn("outcome", outcome)


def mcnemar(improved: Column, regressed: Column) -> Column:
    """Exact two-sided p: min(1, 2 * sum of C(d, k) / 2^d up to the smaller count).

    Terms are summed downwards from the last until they no longer matter, some multiple of the root of d.
    """

    @F.pandas_udf("double")
    def p(up: pd.Series, down: pd.Series) -> pd.Series:
        def one(b: int, c: int) -> float:
            d, last = b + c, min(b, c)
            k = np.arange(last, max(-1, last - 60 - int(40 * math.sqrt(d))), -1, dtype=float)
            first = math.lgamma(d + 1) - math.lgamma(last + 1) - math.lgamma(d - last + 1) - d * math.log(2)
            ratios = np.concatenate([[0.0], np.log(k[:-1]) - np.log(d - k[:-1] + 1)])
            return min(1.0, 2 * float(np.exp(first + np.cumsum(ratios)).sum()))

        return pd.Series([one(int(b), int(c)) for b, c in zip(up, down)], dtype=float)

    return F.round(p(improved, regressed), 9)


def draw(b: Column, j: Column, n: int, seed: int) -> Column:
    """A pseudo-random whole number under ``n`` for draw ``j`` of resample ``b``: three rounds of squaring and scaling modulo 2**31 - 1, in longs only."""
    prime = F.lit((1 << 31) - 1)
    x = (b * F.lit(48271) + j % prime * F.lit(69621) + F.floor(j / prime) * F.lit(16807) + F.lit(seed * 1_000_003 + 12345)) % prime
    for add in (40692, 39373, 742938285):
        x = (x * x % prime * F.lit(16807) + x * F.lit(48271) + b * F.lit(31) + j % prime + F.lit(add)) % prime
    return x % F.lit(n)


def bootstrap(pairs: DataFrame, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """(n, delta, low, high): percentile interval of the mean difference over seeded resamples of the pairs.

    A pair's difference is -1, 0 or 1, so a resample is a draw from three counts, which alone reach the driver: draw j of resample b
    falls where ``draw`` lies in them. Draws are numbers of a range, made and summed in generated code where they are; only one sum a resample and task is moved.
    """
    spark = pairs.sparkSession
    d = F.col("sft").cast("int") - F.col("base").cast("int")
    n, up, down = pairs.agg(F.count(F.lit(1)), F.count_if(d == 1), F.count_if(d == -1)).first()
    if not n:
        return spark.createDataFrame([], "n long, delta double, low double, high double")
    slot = draw(F.col("b"), F.col("j"), n, seed)
    value = F.when(slot < up, 1).when(slot < up + down, -1).otherwise(0)
    draws = spark.range(resamples * n).select(F.floor(F.col("id") / n).cast("long").alias("b"), (F.col("id") % n).alias("j"))
    sums = draws.select("b", value.alias("v")).groupBy("b").agg(F.sum("v").alias("s"))
    k = resamples // 40
    ordered = sums.groupBy().agg(F.array_sort(F.collect_list("s")).alias("s"))  # one number a resample
    at = lambda i: F.round(F.element_at("s", i) / F.lit(n), 9)
    return ordered.select(F.lit(n).cast("long").alias("n"), F.lit(round((up - down) / n, 9)).alias("delta"), at(k).alias("low"), at(resamples - k).alias("high"))


def bootstrap_counts(pairs: DataFrame, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """(n, delta, low, high) as ``bootstrap`` gives them, by drawing each resample's counts instead of its pairs: the work does not depend on the number of pairs.

    How many of n draws fall on improved pairs is binomial, and how many of the others fall on regressed ones is binomial given that: together the exact multinomial
    distribution of a resample. Each resample has a generator of its own from (seed, number), so the result does not depend on partitions.
    """
    spark = pairs.sparkSession
    d = F.col("sft").cast("int") - F.col("base").cast("int")
    n, up, down = pairs.agg(F.count(F.lit(1)), F.count_if(d == 1), F.count_if(d == -1)).first()
    if not n:
        return spark.createDataFrame([], "n long, delta double, low double, high double")

    def run(batches):
        for batch in batches:
            sums = []
            for b in batch["id"]:
                rng = np.random.default_rng((seed, int(b)))
                better = rng.binomial(n, up / n)
                worse = rng.binomial(n - better, min(1.0, down / (n - up))) if n > up else 0
                sums.append(int(better) - int(worse))
            yield pd.DataFrame({"s": sums}, dtype="int64")

    k = resamples // 40
    ordered = spark.range(resamples).mapInPandas(run, "s long").groupBy().agg(F.array_sort(F.collect_list("s")).alias("s"))  # one number a resample
    at = lambda i: F.round(F.element_at("s", i) / F.lit(n), 9)
    return ordered.select(F.lit(n).cast("long").alias("n"), F.lit(round((up - down) / n, 9)).alias("delta"), at(k).alias("low"), at(resamples - k).alias("high"))
