"""Joins and gates that fail, or say why, where a row is not as it must be."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with its match in ``table``; a row without one (or with a null key) fails the job and names the key."""
    marked = table.withColumn("__found", F.lit(True))
    known = F.coalesce(F.col("__found"), F.raise_error(F.concat(F.lit(f"unknown {', '.join(keys)}: "), F.to_json(F.struct(*keys)))).cast("boolean"))
    return rows.join(marked, list(keys), "left").where(known).drop("__found")


def last_row(rows: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The last row in ``order`` of each group (of all rows without ``by``), chosen by an aggregate, not a sort."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in by]), F.struct(*order)).alias("r")).select(*by, "r.*")


# Limits of a run's rolling metrics.
LIMITS = {"verifier_error_rate": 0.02, "invalid_action_rate": 0.25, "sandbox_timeout_rate": 0.10, "ineffective_group_rate": 0.80}


def unhealthy(metrics: DataFrame, order: Sequence[str], limits: Mapping[str, float] = LIMITS) -> DataFrame:
    """(reasons): why the latest metrics stop a run: NaN loss or reward, rates over their limits, or no metrics at all. Unknown rates are no reason."""
    last = metrics.agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct(*metrics.columns), F.struct(*order)).alias("r"))

    def value(name: str) -> Column:
        return F.col("r")[name].cast("double")

    nan = [F.when(F.isnan(value(c)), F.lit(f"NaN {c}")) for c in ("loss", "reward") if c in metrics.columns]
    over = [F.when((value(c) > limit) & ~F.isnan(value(c)), F.concat(F.lit(f"{c}="), value(c).cast("string"), F.lit(f" exceeds {limit}"))) for c, limit in limits.items() if c in metrics.columns]
    return last.select(F.when(F.col("n") == 0, F.array(F.lit("no metrics recorded"))).otherwise(F.array_compact(F.array(F.lit(None).cast("string"), *nan, *over))).alias("reasons"))
