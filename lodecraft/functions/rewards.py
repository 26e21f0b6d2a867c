"""Versioned rewards of verified trajectories, and group-relative advantages."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-6


@dataclass(frozen=True)
class Weights:
    version: str
    tool: float = 0.0
    python: float = 0.0
    invalid: float = 0.0
    token: float = 0.0
    invalid_cap: int = 3
    low: float = -1.0
    high: float = 1.0

    def __post_init__(self):
        if self.low > self.high:
            raise ValueError("low is over high")

    def digest(self) -> Column:
        return F.sha2(F.lit(json.dumps(asdict(self), sort_keys=True)), 256)


# The presets.
PRESETS = {
    "r0": Weights("r0-v1"),
    "r1": Weights("r1-v1", invalid=0.10),
    "r2": Weights("r2-v1", tool=0.15, python=0.10, invalid=0.10),
    "r3": Weights("r3-v1", tool=0.15, python=0.10, invalid=0.10, token=0.05),
}


def reward(w: Weights, correct: Column, tools: Column, python: Column, invalid: Column, tokens: Column, max_tools: Column, max_python: Column, max_tokens: Column) -> Column:
    """A struct of the total and its components; costs are shares of their limits and count for correct answers only."""

    def cost(used: Column, limit: Column, weight: float) -> Column:
        if not weight:
            return F.lit(0.0)
        return F.when(correct & (limit > 0), F.lit(weight) * (used / limit)).otherwise(0.0)

    ok = correct.cast("double")
    tool, secs, tok = cost(tools, max_tools, w.tool), cost(python, max_python, w.python), cost(tokens, max_tokens, w.token)
    penalty = F.lit(w.invalid) * F.least(invalid, F.lit(w.invalid_cap))
    total = ok * (F.lit(1.0) - tool - secs) - penalty - ok * tok
    return F.struct(F.greatest(F.least(total, F.lit(w.high)), F.lit(w.low)).alias("total"), ok.alias("correct"), tool.alias("tool_cost"), secs.alias("python_cost"), tok.alias("token_cost"), penalty.alias("invalid_penalty"))


def group_advantages(rows: DataFrame, group: str, value: str, epsilon: float = EPSILON) -> DataFrame:
    """``advantage`` = (reward - mean) / (population deviation + epsilon) and ``effective``: the group's rewards differ.

    Groups of equal rewards have advantage 0, decided by min = max, not by rounding. Statistics are an aggregate joined back,
    so no group is gathered in a window. Null, infinite and NaN rewards are an error.
    """
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    x = F.col(value)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    checked = rows.withColumn(value, F.when(bad, F.raise_error(F.lit("a reward is not finite")).cast("double")).otherwise(x))
    stats = checked.groupBy(group).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"), (F.min(value) < F.max(value)).alias("effective"))
    return checked.join(stats, group).withColumn("advantage", F.when(F.col("effective"), (F.col(value) - F.col("__m")) / (F.col("__s") + epsilon)).otherwise(0.0)).drop("__m", "__s")


def group_health(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: groups, all-zero, all-one, mixed and effective ones, and the rate of those."""
    per = rows.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    counts = per.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if((F.col("lo") == 0) & (F.col("hi") == 0)).alias("all_zero"), F.count_if((F.col("lo") == 1) & (F.col("hi") == 1)).alias("all_one"), F.count_if(F.col("lo") < F.col("hi")).alias("effective"))
    return counts.withColumn("mixed", F.col("n_groups") - F.col("all_zero") - F.col("all_one")).withColumn("effective_rate", F.round(F.col("effective") / F.col("n_groups"), 9))
