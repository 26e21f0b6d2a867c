"""Recorded trajectories at rest: envelopes with a content digest, or bare trajectories, one JSON object a line."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A trajectory's fields; an event's payload stays JSON, since its fields depend on the event's kind.
TRAJECTORY = """trace_id string, task_id string, events array<struct<sequence:long, kind:string, monotonic_ms:long, payload:string>>, final_answer string,
termination_reason string, usage struct<steps:long, tool_calls:long, invalid_actions:long, generated_tokens:long, python_seconds:double>, runtime_version string"""


def _digest(text: str | None) -> str | None:
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        return None
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()


@F.pandas_udf(StringType())
def _digests(texts: pd.Series) -> pd.Series:
    return texts.map(_digest)


def content_hash(trajectory: Column) -> Column:
    """SHA-256 of a JSON text with sorted keys and no blanks; null for what is not JSON.

    Spark's own JSON functions do not keep the spelling of numbers (1.0 becomes 1), which the digest depends on, hence Python.
    """
    return _digests(trajectory)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """(trace_id, task_id, ..., raw, content_hash): of an envelope its ``trajectory`` and digest, else the line itself without a digest.

    Blank lines are skipped; a line that is no JSON object has nulls in all columns but ``line``.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("inner", F.get_json_object("value", "$.trajectory"))
    raw = F.coalesce("inner", "value")
    parsed = lines.select(raw.alias("raw"), F.get_json_object("value", "$.content_hash").alias("content_hash"), F.from_json(raw, TRAJECTORY).alias("t"), F.col("value").alias("line"))
    return parsed.select("t.*", "raw", "content_hash", "line")


def _payload(e: Column, path: str) -> Column:
    return F.get_json_object(e["payload"], path)


def replay(traces: DataFrame, check_hash: bool = True) -> DataFrame:
    """(trace_id, verdict): whether a recorded trajectory agrees with itself, without a model or tool.

    The first fault decides: ``hash`` (also if there is no digest), ``sequence``, ``time``, ``tokens``, ``answer`` (a final event without text), ``seconds``,
    ``usage`` (counters differ from events), ``final_answer`` (it is not that of the last final event), else ``ok``; ``unreadable`` without events.
    Each row is judged by itself: no shuffle.
    """
    e = F.col("events")
    kinds = lambda *names: F.size(F.filter(e, lambda x: x["kind"].isin(*names))).cast("long")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    of = lambda name: F.filter(e, lambda x: x["kind"] == name)
    tokens = F.transform(of("model_output"), lambda x: F.coalesce(_payload(x, "$.generated_tokens"), F.lit("0")))
    answers = F.transform(of("final"), lambda x: F.coalesce(_payload(x, "$.answer"), F.lit("")))
    python = F.filter(of("tool_result"), lambda x: _payload(x, "$.name") == "python")
    seconds = F.transform(python, lambda x: F.coalesce(_payload(x, "$.result.metadata.execution_time"), F.lit("0")))
    number = lambda x: x.try_cast("double")
    u = F.col("usage")
    same = (
        (F.coalesce(u["steps"], F.lit(0)) == kinds("tool_call", "invalid_action", "final"))
        & (F.coalesce(u["tool_calls"], F.lit(0)) == kinds("tool_call"))
        & (F.coalesce(u["invalid_actions"], F.lit(0)) == kinds("invalid_action"))
        & (F.coalesce(u["generated_tokens"], F.lit(0)).cast("double") == total(F.transform(tokens, number)))
        & (F.abs(F.coalesce(u["python_seconds"], F.lit(0.0)) - total(F.transform(seconds, number))) < 1e-9)
    )
    verdict = F.when(e.isNull(), "unreadable")
    if check_hash:
        verdict = verdict.when(~F.coalesce(content_hash(F.col("raw")) == F.col("content_hash"), F.lit(False)), "hash")
    verdict = (
        verdict.when(F.exists(F.transform(e, lambda x, i: ~x["sequence"].eqNullSafe(i.cast("long"))), lambda x: x), "sequence")
        .when(F.exists(F.transform(e, lambda x, i: F.coalesce(x["monotonic_ms"] < F.when(i > 0, F.element_at(e, F.greatest(i, F.lit(1)))["monotonic_ms"]).otherwise(0), F.lit(True))), lambda x: x), "time")
        .when(F.exists(tokens, lambda t: ~t.rlike("^[0-9]+$")), "tokens")
        .when(F.exists(answers, lambda a: a == ""), "answer")
        .when(F.exists(seconds, lambda s: F.coalesce(number(s) < 0, F.lit(True))), "seconds")
        .when(~same, "usage")
        .when((F.col("termination_reason") == "final") & ~F.when(F.size(answers) > 0, F.element_at(answers, -1)).eqNullSafe(F.col("final_answer")), "final_answer")
        .otherwise("ok")
    )
    return traces.select("trace_id", verdict.alias("verdict"))
