"""Recorded traces: order, usage, replay, episodes, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Event kinds that count as steps.
STEPS = ("tool_call", "invalid_action", "final")


def usage_columns(window: Column | None = None) -> dict[str, Column]:
    """Counters of events by kind, as aggregates or running over a window."""
    kind = F.col("kind")
    sums = {
        "steps": F.sum(kind.isin(*STEPS).cast("long")),
        "tool_calls": F.sum((kind == "tool_call").cast("long")),
        "invalid_actions": F.sum((kind == "invalid_action").cast("long")),
        "generated_tokens": F.sum(F.when(kind == "model_output", F.col("tokens")).otherwise(0)),
        "python_seconds": F.sum(F.when(kind == "tool_result", F.col("seconds").cast("decimal(18,6)")).otherwise(F.lit(0).cast("decimal(18,6)"))),
    }
    return {k: (v.over(window) if window is not None else v).cast("double" if k == "python_seconds" else "long") for k, v in sums.items()}


def usage(events: DataFrame) -> DataFrame:
    """Usage of each trace: one aggregate, combined before the shuffle."""
    return events.groupBy("trace_id").agg(*[c.alias(n) for n, c in usage_columns().items()])


def order_check(events: DataFrame) -> DataFrame:
    """(trace_id, events, sequence_ok, time_ok): sequences run from 0 without gaps; time never falls."""
    w = Window.partitionBy("trace_id").orderBy("sequence")
    marked = events.withColumn("gap", F.col("sequence") != F.row_number().over(w) - 1).withColumn("back", F.col("monotonic_ms") < F.coalesce(F.lag("monotonic_ms").over(w), F.lit(-1)))
    return marked.groupBy("trace_id").agg(F.count(F.lit(1)).alias("events"), (~F.bool_or("gap")).alias("sequence_ok"), (~F.bool_or("back")).alias("time_ok"))


def replay(events: DataFrame) -> DataFrame:
    """(trace_id, verdict, usage..., final_ms): ``sequence``, ``time`` or ``ok``, with the usage that the events imply."""
    checked = order_check(events)
    last = F.max_by(F.when(F.col("kind") == "final", F.col("monotonic_ms")), F.when(F.col("kind") == "final", F.col("sequence")))
    totals = events.groupBy("trace_id").agg(*[c.alias(n) for n, c in usage_columns().items()], last.alias("final_ms"))
    verdict = F.when(~F.col("sequence_ok"), "sequence").when(~F.col("time_ok"), "time").otherwise("ok")
    return checked.join(totals, "trace_id").select("trace_id", verdict.alias("verdict"), *usage_columns(), "final_ms")


def episodes(events: DataFrame, max_steps: int, max_tools: int, max_seconds: float) -> DataFrame:
    """Each trace's actions replayed against a budget: (trace_id, steps, tool_calls, invalid_actions, python_seconds, reason).

    A fold over the trace's events in order. A final action ends the episode. A tool call over the tool budget is an invalid
    action instead; a termination event cancels the episode. After each action, reached step or Python limits end the episode; what follows is ignored. A trace is
    one array, bounded by the length of an episode.
    """
    event = F.struct("sequence", "kind", F.col("seconds").cast("double").alias("seconds"))
    ordered = events.groupBy("trace_id").agg(F.array_sort(F.collect_list(event)).alias("e"))
    start = F.struct(F.lit(0).cast("long").alias("steps"), F.lit(0).cast("long").alias("tool_calls"), F.lit(0).cast("long").alias("invalid_actions"), F.lit(0.0).alias("python_seconds"), F.lit(None).cast("string").alias("reason"))

    def step(s: Column, e: Column) -> Column:
        live = s["reason"].isNull()
        refused = (e["kind"] == "tool_call") & (s["tool_calls"] >= max_tools)
        is_step = e["kind"].isin(*STEPS)
        invalid = (e["kind"] == "invalid_action") | refused
        steps = s["steps"] + F.when(live & is_step, 1).otherwise(0)
        seconds = F.round(s["python_seconds"] + F.when(live & (e["kind"] == "tool_result"), e["seconds"]).otherwise(0.0), 6)
        acted = is_step | (e["kind"] == "tool_result")
        reason = F.when(~live, s["reason"]).when(e["kind"] == "final", "final").when(e["kind"] == "termination", "cancelled").when(acted & (steps >= max_steps), "max_steps").when(acted & (seconds > 0) & (seconds >= max_seconds), "python_time_budget")
        return F.struct(steps.cast("long").alias("steps"), (s["tool_calls"] + F.when(live & (e["kind"] == "tool_call") & ~refused, 1).otherwise(0)).cast("long").alias("tool_calls"), (s["invalid_actions"] + F.when(live & invalid, 1).otherwise(0)).cast("long").alias("invalid_actions"), seconds.alias("python_seconds"), reason.alias("reason"))

    return ordered.select("trace_id", F.aggregate("e", start, step).alias("s")).select("trace_id", "s.*")


def conversation_protocol(messages: DataFrame) -> DataFrame:
    """(conv_id, starts_ok, tools_ok, ends_final): system then user first; a tool message only after a tool action; the last action final."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    m = messages.withColumn("before", F.lag("action").over(w)).withColumn("i", F.row_number().over(w))
    return m.groupBy("conv_id").agg(
        (F.coalesce(F.bool_or((F.col("i") == 1) & (F.col("role") == "system")), F.lit(False)) & F.coalesce(F.bool_or((F.col("i") == 2) & (F.col("role") == "user")), F.lit(False))).alias("starts_ok"),
        F.bool_and((F.col("role") != "tool") | F.coalesce(F.col("before") == "tool", F.lit(False))).alias("tools_ok"),
        F.coalesce(F.max_by("action", "turn") == "final", F.lit(False)).alias("ends_final"),
    )
