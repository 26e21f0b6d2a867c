"""The planner, tool, critic and executor loop as a bounded fold over recorded node events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the loop's limit.
MAX_STEPS = 20


def next_status(event: Column, errors: Column, max_errors: int) -> Column:
    """The status after a node's event, given the errors so far."""
    return (
        F.when(event == "answered", "completed").when((event == "tool_error") & (errors >= max_errors), "failed")
        .when(event == "tool_error", "retrying").when(event == "planned", "planning").otherwise("executing")
    )


def workflow(events: DataFrame, key: str, order: str, event: str, max_errors: int = 3) -> DataFrame:
    """(key, steps, errors, status): each key's events folded in order, up to an end state or MAX_STEPS."""
    gathered = events.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct(order, F.col(event).alias("e")))), 1, MAX_STEPS).alias("es"))
    start = F.struct(F.lit(0).cast("long").alias("steps"), F.lit(0).cast("long").alias("errors"), F.lit("pending").alias("status"))

    def step(s: Column, x: Column) -> Column:
        over = s["status"].isin("completed", "failed")
        errors = s["errors"] + F.when(~over & (x["e"] == "tool_error"), 1).otherwise(0)
        status = F.when(over, s["status"]).otherwise(next_status(x["e"], errors, max_errors))
        return F.struct((s["steps"] + F.when(over, 0).otherwise(1)).cast("long").alias("steps"), errors.cast("long").alias("errors"), status.alias("status"))

    return gathered.select(key, F.aggregate("es", start, step).alias("s")).select(key, "s.*")
