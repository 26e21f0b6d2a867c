"""One assistant turn: its action, and text that tools and prompts are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of a turn and its parts, and the envelope.
MAX_RAW, MAX_REASONING, MAX_ANSWER, MAX_NAME = 32768, 24576, 8192, 64
ENVELOPE = r"(?s)^(?:<think>((?:(?!<think>|</think>).)*)</think>)?\s*(?:<tool_call>(.*?)</tool_call>|<final>(.*?)</final>)$"
ERRORS = ("empty", "too_long", "multiple_actions", "invalid_envelope", "invalid_json", "invalid_schema")


def parse_action(raw: Column) -> Column:
    """struct<kind, reasoning, answer, tool, arguments, error, raw_hash>: nothing in the payload is run.

    Errors are tested in the order of ``ERRORS``. A tool call has exactly a name and an object of arguments, a final
    action exactly a non-empty string answer.
    """
    t = F.regexp_replace(raw, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    actions = F.regexp_count(t, F.lit("<tool_call>|<final>"))
    fits = t.rlike(ENVELOPE)
    is_tool = F.contains(t, F.lit("<tool_call>"))
    payload = F.regexp_extract(t, ENVELOPE, 2)
    payload = F.when(is_tool, payload).otherwise(F.regexp_extract(t, ENVELOPE, 3))
    parsed = F.try_parse_json(payload)
    shape = lambda path: F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    is_object = F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    fields = F.size(F.json_object_keys(payload))
    name, answer = F.try_variant_get(parsed, "$.name", "string"), F.try_variant_get(parsed, "$.answer", "string")
    tool_ok = (fields == 2) & (shape("$.name") == "STRING") & name.rlike("^[a-z][a-z0-9_]*$") & (F.length(name) <= MAX_NAME) & F.startswith(shape("$.arguments"), F.lit("OBJECT"))
    final_ok = (fields == 1) & (shape("$.answer") == "STRING") & F.length(answer).between(1, MAX_ANSWER)
    good = F.coalesce(is_object & F.when(is_tool, tool_ok).otherwise(final_ok), F.lit(False))
    error = (
        F.when(t == "", "empty").when(F.length(t) > MAX_RAW, "too_long").when(actions > 1, "multiple_actions").when(~fits, "invalid_envelope")
        .when(F.length(F.regexp_extract(t, ENVELOPE, 1)) > MAX_REASONING, "invalid_schema").when(parsed.isNull(), "invalid_json").when(~good, "invalid_schema")
    )
    ok = error.isNull()
    return F.struct(
        F.when(ok, F.when(is_tool, "tool_call").otherwise("final")).alias("kind"),
        F.when(ok & F.startswith(t, F.lit("<think>")), F.regexp_extract(t, ENVELOPE, 1)).alias("reasoning"),
        F.when(ok & ~is_tool, answer).alias("answer"),
        F.when(ok & is_tool, name).alias("tool"),
        F.when(ok & is_tool, F.get_json_object(payload, "$.arguments")).alias("arguments"),
        error.alias("error"),
        F.sha2(raw.cast("binary"), 256).alias("raw_hash"),
    )


def unsafe_expression(text: Column, limit: int = 2048) -> Column:
    """What an algebra tool refuses: double underscores, attribute access, quotes, brackets of code, long text."""
    return (F.length(text) > limit) | text.rlike(r"__|[A-Za-z_]\s*\.|\.\s*[A-Za-z_]|['\"`;\\@\[\]{}]|\b(?:lambda|import|eval|exec|open)\b")


def format_output(stdout: Column, stderr: Column) -> Column:
    """The streams that have content, each under its name."""
    part = lambda name, x: F.when(x.isNotNull() & (x != ""), F.concat(F.lit(f"{name}:\n"), x))
    return F.concat_ws("\n", part("stdout", stdout), part("stderr", stderr))


def python_fence(text: Column) -> Column:
    """The code of the only fenced Python block; null if there is none or more than one."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```python[ \t]*\n(.*?)\n?```"), F.lit(1))
    return F.when(F.size(blocks) == 1, F.get(blocks, F.lit(0)))
