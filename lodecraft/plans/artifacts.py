"""Queries over what lies in files beside the tables: registries, traces, journals, publications; and over plugged-in parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dispatch import Rewards, add_python_tool, standard
from ..functions.tools import Registry
from ..operators import generation, guards
from ..sources import config, files, publish
from ..sources import traces as recorded
from ..sources.journal import Journal
from ..storage import new_path
from .registry import query
from .views import PREDICTIONS, TRACES, predictions, table, traces


@query("registry_scan", "SELECT r_name AS source, CASE WHEN r_regionkey % 2 = 0 THEN 'train' ELSE 'eval' END AS intended_use, repeat(CAST(r_regionkey AS VARCHAR), 40) AS revision, '{\"path\": \"' || r_name || '\"}' AS loader_params FROM region")
def _(spark, d):
    path = f"{new_path(spark, 'registry')}.json"
    spec = lambda r: {"name": r.r_name, "uri": "file:///", "revision": str(r.r_regionkey) * 40, "license": "mit", "intended_use": ("train", "eval")[r.r_regionkey % 2], "citation": "", "loader": "parquet", "answer_type": "integer", "loader_params": {"path": r.r_name}}
    files.write_json(spark, path, {"version": "1", "sources": {r.r_name: spec(r) for r in table(spark, d, "region").collect()}})
    return config.load_registry(spark, path).frame(spark).select("source", "intended_use", "revision", "loader_params")


def _lines(spark, d):
    """Trajectories made of recorded events: every third one bare, every fifth of the others under a wrong digest, every seventh with wrong counters."""
    payload = F.when(F.col("kind") == "model_output", F.to_json(F.struct(F.col("tokens").alias("generated_tokens")))).when(F.col("kind") == "final", F.lit('{"answer":"42"}')).otherwise("{}")
    event = F.concat(F.lit('{"kind":"'), F.col("kind"), F.lit('","monotonic_ms":'), F.col("monotonic_ms").cast("string"), F.lit(',"payload":'), payload, F.lit(',"sequence":'), F.col("sequence").cast("string"), F.lit("}"))
    counted = {"steps": F.col("kind").isin("tool_call", "invalid_action", "final"), "tool_calls": F.col("kind") == "tool_call", "invalid_actions": F.col("kind") == "invalid_action"}
    e = traces(spark, d).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("sequence", event.alias("j")))).alias("e"), *[F.count_if(c).alias(n) for n, c in counted.items()], F.sum(F.when(F.col("kind") == "model_output", F.col("tokens")).otherwise(0)).alias("generated_tokens"), F.bool_or(F.col("kind") == "final").alias("done"))
    usage = F.format_string('{"generated_tokens":%d,"invalid_actions":%d,"steps":%d,"tool_calls":%d}', "generated_tokens", "invalid_actions", F.col("steps") + F.when(F.col("trace_id") % 7 == 0, 1).otherwise(0), "tool_calls")
    end = F.when(F.col("done"), F.lit('"42","termination_reason":"final"')).otherwise(F.lit('null,"termination_reason":"max_steps"'))
    text = F.concat(F.lit('{"events":['), F.array_join(F.transform("e", lambda x: x["j"]), ","), F.lit('],"final_answer":'), end, F.lit(',"trace_id":"'), F.col("trace_id").cast("string"), F.lit('","usage":'), usage, F.lit("}"))
    digest = F.when(F.col("trace_id") % 5 == 0, F.lit("0" * 64)).otherwise(F.sha2(F.col("t"), 256))
    spaced = F.regexp_replace("t", '^\\{"events":', '{ "events" : ')
    line = F.when(F.col("trace_id") % 3 == 0, F.col("t")).otherwise(F.concat(F.lit('{"content_hash":"'), digest, F.lit('","trajectory":'), spaced, F.lit("}")))
    path = new_path(spark, "traces")
    e.withColumn("t", text).select(line.alias("value")).write.text(path)
    return recorded.read_traces(spark, path)


@query("scan_mixed_traces", f"WITH {TRACES} SELECT CAST(trace_id AS VARCHAR) AS trace_id, count(*) AS n_events, trace_id % 3 <> 0 AS in_envelope, min(monotonic_ms) AS first_ms, bool_or(kind = 'final') AS done FROM traces GROUP BY trace_id")
def _(spark, d):
    t = _lines(spark, d)
    return t.select("trace_id", F.size("events").cast("long").alias("n_events"), F.col("content_hash").isNotNull().alias("in_envelope"), F.array_min(F.col("events.monotonic_ms")).alias("first_ms"), F.col("final_answer").isNotNull().alias("done"))


@query("trace_replay_hashed", f"""WITH {TRACES}, o AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY sequence) - 1 AS i, lag(monotonic_ms) OVER (PARTITION BY trace_id ORDER BY sequence) AS before FROM traces)
SELECT CAST(trace_id AS VARCHAR) AS trace_id, CASE WHEN trace_id % 3 = 0 OR trace_id % 5 = 0 THEN 'hash' WHEN bool_or(sequence <> i) THEN 'sequence' WHEN bool_or(monotonic_ms < coalesce(before, 0)) THEN 'time' WHEN bool_or(kind = 'model_output' AND coalesce(tokens, 0) < 0) THEN 'tokens' WHEN trace_id % 7 = 0 THEN 'usage' ELSE 'ok' END AS verdict FROM o GROUP BY trace_id""")
def _(spark, d):
    return recorded.replay(_lines(spark, d))


@query("journal_bound", f"WITH {PREDICTIONS} SELECT arm, count(*) AS done, sum(output_tokens)::BIGINT AS tokens FROM predictions WHERE batch % 3 <> 2 GROUP BY 1")
def _(spark, d):
    schema = "arm string, task_id long, batch long, output_tokens long"
    rows, path = predictions(spark, d), new_path(spark, "journal")
    for part in (0, 1, 1):  # the last is added again, as after a restart
        Journal(spark, path, {"tables": d}, schema).append(rows.where(f"batch % 3 = {part}"), part)
    return Journal(spark, path, {"tables": d}, schema).rows().groupBy("arm").agg(F.count(F.lit(1)).alias("done"), F.sum("output_tokens").alias("tokens"))


@query("publish_artifacts", f"WITH {PREDICTIONS} SELECT arm, task_id, status FROM predictions")
def _(spark, d):
    rows = predictions(spark, d).select("arm", "task_id", "status")
    path = new_path(spark, "published")
    publish.publish(spark, path, {a: rows.where(F.col("arm") == a) for a in ("base", "sft")}, {"prompt": "v1"}, {"evaluation_report.md": "# Report\n"})
    publish.published(spark, path)
    return spark.read.schema("arm string, task_id long, status string").json([f"{path}/{a}.jsonl" for a in ("base", "sft")])


@query("eval_report_rows", f"WITH {PREDICTIONS}, a AS (SELECT arm, count(*) FILTER (status = 'correct') AS c, count(*) AS n, count(*) FILTER (status IN ('correct', 'incorrect')) AS v, max(latency_ms) AS p FROM predictions GROUP BY 1) SELECT arm, printf('| %s | %d/%d | %.2f%% | %.2f%% | %.2f | n/a | n/a | n/a |', arm, c, n, 100.0::DOUBLE * v / n, 100.0::DOUBLE * c / n, p) AS line FROM a")
def _(spark, d):
    a = predictions(spark, d).groupBy("arm").agg(F.count_if(F.col("status") == "correct").alias("c"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin("correct", "incorrect")).alias("v"), F.max("latency_ms").alias("p"))
    none = F.lit(None).cast("double")
    return a.select("arm", publish.report_row(F.col("arm"), F.col("c"), F.col("n"), F.col("v") / F.col("n"), F.col("p"), none, none, none).alias("line"))


@query("split_manifest", "SELECT lang AS name, count(*) AS n, count(*) FILTER (doc_id IS NOT NULL) AS ids FROM documents GROUP BY 1")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    path = new_path(spark, "splits")
    docs.write.partitionBy("lang").json(path)
    files.folder_digest(spark, path)
    return spark.read.schema("doc_id long, lang string").json(path).groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids"))


@query("known_customers", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def _(spark, d):
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return guards.lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), names, ["o_custkey"]).select("o_orderkey", "c_name")


@query("health_latest", "SELECT list_filter([CASE WHEN r > 0.02 THEN 'verifier_error_rate' END, CASE WHEN r > 0.25 THEN 'invalid_action_rate' END], lambda x: x IS NOT NULL) AS names FROM (SELECT arg_max(value / 1000, event_id) AS r FROM events)")
def _(spark, d):
    rate = F.col("value") / 1000
    found = guards.unhealthy(table(spark, d, "events").select("event_id", rate.alias("verifier_error_rate"), rate.alias("invalid_action_rate")), ["event_id"])
    return found.select(F.transform("reasons", lambda r: F.split_part(r, F.lit("="), F.lit(1))).alias("names"))


@query("verify_by_type", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'correct' ELSE 'incorrect' END WHEN 1 THEN 'correct' WHEN 2 THEN CASE WHEN n_chars % 5 = 0 THEN 'correct' ELSE 'incorrect' END ELSE 'invalid_reference' END AS verdict FROM documents")
def _(spark, d):
    doc, n = F.col("doc_id"), F.col("n_chars")
    text = lambda c: c.cast("string")
    kind = F.element_at(F.array(F.lit("integer"), F.lit("set"), F.lit("rational"), F.lit("unknown")), (doc % 4 + 1).cast("int"))
    given = F.when(kind == "set", F.format_string("{%d, %d}", n, doc + 1)).when(kind == "rational", F.concat(text(n * 2), F.lit("/10"))).otherwise(text(doc + doc % 3))
    wanted = F.when(kind == "set", F.format_string("{%d,%d}", doc + 1, n)).when(kind == "rational", text(F.floor(n / 5))).otherwise(text(doc))
    return table(spark, d, "documents").select("doc_id", standard().verdict(given, wanted, kind).alias("verdict"))


@query("reward_registry", "SELECT doc_id, round(0.5 * (n_chars % 7) + 2.0 * (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END), 9) AS reward FROM documents")
def _(spark, d):
    rewards = Rewards()
    rewards.register("length")(lambda c: (c["n"] % 7).cast("double"))
    rewards.register("even")(lambda c: F.when(c["id"] % 2 == 0, 1.0).otherwise(0.0))
    return table(spark, d, "documents").select("doc_id", F.round(rewards.composite({"length": 0.5, "even": 2.0}, {"n": F.col("n_chars"), "id": F.col("doc_id")})["total"], 9).alias("reward"))


def scripted(conversations):
    """A model whose turns follow from the problem, a number: its double by the tool if it is even, nonsense if 3 divides it, else the number."""
    turns = []
    for c in conversations:
        n = int(c[1][1])
        if n % 2 == 0 and len(c) == 2:
            turns.append((f'<tool_call>{{"name": "double", "arguments": {{"x": "{n}"}}}}</tool_call>', 2))
        elif n % 2 and n % 3 == 0:
            turns.append(("nonsense", 1))
        else:
            turns.append((f'<final>{{"answer": "{c[-1][1]}"}}</final>', 3))
    return turns


def _double(value: str) -> str:
    return str(2 * int(value))


_EPISODES = """e AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN CAST(2 * item_id AS VARCHAR) WHEN item_id % 3 <> 0 THEN CAST(item_id AS VARCHAR) END AS final_answer, CASE WHEN item_id % 2 = 1 AND item_id % 3 = 0 THEN 'max_steps' ELSE 'final' END AS reason,
CASE WHEN item_id % 2 = 0 THEN 2 WHEN item_id % 3 = 0 THEN 3 ELSE 1 END AS steps, CASE WHEN item_id % 2 = 0 THEN 5 ELSE 3 END AS generated_tokens FROM benchmark)"""


def _episodes(spark, d):
    registry = Registry()
    add_python_tool(registry, "double", _double, F.get_json_object("arguments", "$.x"))
    tasks = table(spark, d, "benchmark").select("item_id", F.col("item_id").cast("string").alias("problem"))
    return generation.run_episodes(tasks, scripted, registry, "solve", 3, 1, key="item_id")


@query("agent_episodes", f"WITH {_EPISODES} SELECT * FROM e")
def _(spark, d):
    return _episodes(spark, d).select("item_id", "final_answer", "reason", "steps", "generated_tokens")


@query("verified_episodes", f"WITH {_EPISODES} SELECT item_id, steps FROM e WHERE final_answer = CAST(CASE WHEN item_id % 5 = 0 THEN 0 ELSE 2 * item_id END AS VARCHAR)")
def _(spark, d):
    labels = table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 5 == 0, F.lit("0")).otherwise((F.col("item_id") * 2).cast("string")).alias("reference_value"), F.lit("integer").alias("answer_type"))
    return generation.verified_only(_episodes(spark, d), labels, standard(), key="item_id").select("item_id", "steps")
