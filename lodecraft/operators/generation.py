"""Text from a model, as a frame: batches of prompts, whole episodes with tools, and episodes kept only if their answer is right.

A model is any picklable callable from a list of conversations (lists of (role, content)) to a list of (text, generated tokens).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions.actions import parse_action
from ..functions.dispatch import Verifiers
from ..functions.tools import Registry

Model = Callable[[Sequence[Sequence[tuple[str, str]]]], Sequence[tuple[str, int]]]
MESSAGES = "array<struct<role:string, content:string>>"


def generate(prompts: DataFrame, model: Model, key: str = "task_id", batch: int = 16) -> DataFrame:
    """(key, text, generated_tokens, latency_ms, error) for rows (key, messages): ``batch`` conversations a call.

    A call that raises, or answers with another number of turns, marks its rows with the error; it stops no other. Latency is that of the row's call.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in range(0, len(frame), batch):
                part = frame.iloc[first : first + batch]
                start, turns, error = time.monotonic(), None, None
                try:
                    turns = list(model([[(m["role"], m["content"]) for m in c] for c in part["messages"]]))
                    if len(turns) != len(part):
                        raise ValueError(f"{len(turns)} turns for {len(part)} prompts")
                except Exception as fault:
                    turns, error = [(None, 0)] * len(part), f"{type(fault).__name__}: {fault}"
                ms = round((time.monotonic() - start) * 1000)
                yield pd.DataFrame({key: part[key], "text": [t for t, _ in turns], "generated_tokens": [n for _, n in turns], "latency_ms": ms, "error": error})

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, "messages").mapInPandas(run, f"`{key}` {kind}, text string, generated_tokens long, latency_ms long, error string")


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def run_episodes(tasks: DataFrame, model: Model, registry: Registry, system: str, max_steps: int, max_tools: int, key: str = "task_id", batch: int = 16, cancelled: Callable[[], bool] | None = None) -> DataFrame:
    """(key, final_answer, reason, steps, tool_calls, invalid_actions, generated_tokens, messages) of each task (key, problem).

    One round a step: all live episodes get a turn, which is parsed and stepped by Spark's own expressions; ended ones leave. A tool's columns
    in ``registry`` may use ``arguments`` (JSON). Reasons: ``final``, ``max_steps``, ``model_error``, ``cancelled`` (asked before each round).
    Keys must be unique and not null. Every round is written, so a lost executor repeats only tasks of the current one, and no model call is
    evaluated twice by a later round; what one needs is bounded by an episode's length.
    """
    zero = [F.lit(0).cast("long").alias(c) for c in ("steps", "tool_calls", "invalid_actions", "generated_tokens")]
    names = [key, "final_answer", "reason", "steps", "tool_calls", "invalid_actions", "generated_tokens", "messages"]
    text = lambda: F.lit(None).cast("string")
    live = tasks.select(key, text().alias("final_answer"), text().alias("reason"), *zero, F.array(_message("system", F.lit(system)), _message("user", F.col("problem"))).cast(MESSAGES).alias("messages"))
    done = None
    for _ in range(max_steps):
        if cancelled is not None and cancelled():
            break
        turns = storage.materialise(generate(live, model, key, batch).withColumnRenamed("generated_tokens", "new_tokens"), "turns")
        at = live.join(turns, key).withColumn("a", parse_action(F.coalesce("text", F.lit(""))))
        failed, kind = F.col("error").isNotNull(), F.col("a.kind")
        call = ~failed & kind.eqNullSafe("tool_call")
        refused = call & (F.col("tool_calls") >= max_tools)
        invalid = (~failed & kind.isNull()) | refused
        at = at.withColumn("arguments", F.when(call & ~refused, F.col("a.arguments"))).withColumn("r", registry.run(F.when(call & ~refused, F.col("a.tool"))))
        steps = F.col("steps") + F.when(failed, 0).otherwise(1)
        reason = F.when(failed, "model_error").when(kind == "final", "final").when(steps >= max_steps, "max_steps")
        seen = F.when(refused, "error: tool budget").when(invalid, F.concat(F.lit("error: "), F.col("a.error"))).when(F.col("r.ok"), F.col("r.output")).otherwise(F.concat(F.lit("error: "), F.col("r.error_code")))
        said = F.when(failed, F.col("messages")).otherwise(F.concat("messages", F.array(_message("assistant", F.col("text")))))
        whole = F.when(reason.isNull(), F.concat(said, F.array(_message("tool", F.coalesce(seen, F.lit("")))))).otherwise(said).cast(MESSAGES)
        count = lambda c, hit: (F.col(c) + hit.cast("long")).cast("long").alias(c)
        stepped = at.select(key, F.col("a.answer").alias("final_answer"), reason.alias("reason"), steps.cast("long").alias("steps"), count("tool_calls", call & ~refused), count("invalid_actions", invalid), (F.col("generated_tokens") + F.col("new_tokens")).alias("generated_tokens"), whole.alias("messages"))
        now = storage.materialise(stepped.select(*names), "episodes")
        ended, live = now.where("reason is not null"), now.where("reason is null")
        done = ended if done is None else done.unionByName(ended)
        if live.isEmpty():
            break
    rest = live.withColumn("reason", F.lit("cancelled"))
    return rest.select(*names) if done is None else done.unionByName(rest)


def verified_only(episodes: DataFrame, references: DataFrame, verifiers: Verifiers, key: str = "task_id") -> DataFrame:
    """Episodes that ended with an answer which its reference (key, reference_value, answer_type) makes correct; the labels do not come along."""
    labelled = episodes.where("reason = 'final'").join(references.select(key, "reference_value", "answer_type"), key)
    return labelled.where(verifiers.verdict(F.col("final_answer"), F.col("reference_value"), F.col("answer_type")) == "correct").select(*episodes.columns)
