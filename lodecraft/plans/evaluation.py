"""Queries over predictions, rollouts, rewards and traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rewards as R
from ..operators import evaluation as E
from ..operators import traces as T
from ..operators.quantiles import quantiles
from .registry import query
from .views import MESSAGES, PREDICTIONS, ROLLOUTS, TRACES, messages, predictions, rollouts, table, traces

P = f"WITH {PREDICTIONS}"
PAIRED = f"{P}, pairs AS (SELECT task_id, bool_or(CASE WHEN arm = 'base' THEN correct END) AS base, bool_or(CASE WHEN arm = 'sft' THEN correct END) AS sft FROM predictions GROUP BY 1), outcomes AS (SELECT *, CASE WHEN sft AND NOT base THEN 'improved' WHEN base AND NOT sft THEN 'regressed' ELSE 'unchanged' END AS outcome FROM pairs)"
_COUNTS = "count(*) FILTER (status = 'correct') AS n_correct, count(*) FILTER (status = 'incorrect') AS n_incorrect, count(*) FILTER (status = 'invalid_prediction') AS n_invalid_prediction, count(*) FILTER (status = 'invalid_reference') AS n_invalid_reference, count(*) FILTER (status = 'timeout') AS n_timeout, count(*) FILTER (status = 'internal_error') AS n_internal_error, round(count(*) FILTER (status IN ('correct', 'incorrect')) / count(*), 9) AS valid_rate"


@query("arm_summary", f"""{P}, m AS (SELECT arm, count(*) AS n, {_COUNTS}, round(avg(correct::INTEGER), 9) AS accuracy, round(avg(output_tokens), 9) AS mean_tokens, quantile_cont(output_tokens, 0.5)::DOUBLE AS median_tokens, round(quantile_cont(latency_ms, 0.5), 9) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 9) AS p95_ms, sum(output_tokens)::BIGINT AS tokens FROM predictions GROUP BY 1),
b AS (SELECT arm, round(sum(ms) / 1000, 6) AS elapsed_s FROM (SELECT arm, batch, max(latency_ms) AS ms FROM predictions GROUP BY 1, 2) GROUP BY 1)
SELECT m.*, elapsed_s, round(tokens / elapsed_s, 6) AS tokens_per_s FROM m JOIN b USING (arm)""")
def _(spark, d):
    return E.arm_summary(predictions(spark, d))


@query("percentile_exact", "SELECT lang, round(quantile_cont(n_chars, 0.25), 6) AS p25, round(quantile_cont(n_chars, 0.9), 6) AS p90 FROM documents GROUP BY 1")
def _(spark, d):
    found = quantiles(table(spark, d, "documents"), ["lang"], {"p25": ("n_chars", 0.25), "p90": ("n_chars", 0.9)})
    return found.select("lang", F.round("p25", 6).alias("p25"), F.round("p90", 6).alias("p90"))


@query("paired_outcomes", f"{PAIRED} SELECT task_id, base, sft, outcome FROM outcomes")
def _(spark, d):
    return E.paired(predictions(spark, d))


@query("paired_join", f"{P} SELECT b.task_id, b.status AS base_status, s.status AS sft_status FROM predictions b JOIN predictions s ON b.task_id = s.task_id AND b.arm = 'base' AND s.arm = 'sft'")
def _(spark, d):
    p = predictions(spark, d)
    b, s = p.where("arm = 'base'").select("task_id", F.col("status").alias("base_status")), p.where("arm = 'sft'").select("task_id", F.col("status").alias("sft_status"))
    return b.join(s, "task_id")


@query("paired_outcome_counts", f"{PAIRED} SELECT outcome, count(*) AS n FROM outcomes GROUP BY 1")
def _(spark, d):
    return E.paired(predictions(spark, d)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("accuracy_delta", f"{PAIRED} SELECT round(avg(sft::INTEGER - base::INTEGER), 9) AS delta FROM outcomes")
def _(spark, d):
    return E.paired(predictions(spark, d)).agg(F.round(F.avg(F.col("sft").cast("int") - F.col("base").cast("int")), 9).alias("delta"))


@query("mcnemar_exact", f"""{PAIRED}, c AS (SELECT count(*) FILTER (outcome = 'improved') AS improved, count(*) FILTER (outcome = 'regressed') AS regressed FROM outcomes),
t AS (SELECT improved, regressed, k, sum(CASE WHEN k = 0 THEN 0 ELSE ln((improved + regressed - k + 1) / k::DOUBLE) END) OVER (ORDER BY k) - (improved + regressed) * ln(2.0) AS term FROM c, range(0, 100000) r(k) WHERE k <= least(improved, regressed))
SELECT improved, regressed, round(least(1.0, 2 * sum(exp(term))), 9) AS p FROM t GROUP BY 1, 2""")
def _(spark, d):
    c = E.paired(predictions(spark, d)).agg(F.count_if(F.col("outcome") == "improved").alias("improved"), F.count_if(F.col("outcome") == "regressed").alias("regressed"))
    return c.withColumn("p", E.mcnemar(F.col("improved"), F.col("regressed")))


@query("bootstrap_ci", f"""{PAIRED}, c AS (SELECT count(*) AS n, count(*) FILTER (outcome = 'improved') AS up, count(*) FILTER (outcome = 'regressed') AS down FROM outcomes),
x0 AS (SELECT n, up, down, b, j, (b * 48271 + j * 69621 + 12345) % 2147483647 AS x FROM c, range(0, 10000) x(b), range(0, 1000000) y(j) WHERE j < n),
x1 AS (SELECT n, up, down, b, j, (x * x % 2147483647 * 16807 + x * 48271 + b * 31 + j + 40692) % 2147483647 AS x FROM x0),
x2 AS (SELECT n, up, down, b, j, (x * x % 2147483647 * 16807 + x * 48271 + b * 31 + j + 39373) % 2147483647 AS x FROM x1),
dr AS (SELECT n, up, down, b, (x * x % 2147483647 * 16807 + x * 48271 + b * 31 + j + 742938285) % 2147483647 % n AS slot FROM x2),
m AS (SELECT n, up, down, b, sum(CASE WHEN slot < up THEN 1 WHEN slot < up + down THEN -1 ELSE 0 END) AS s FROM dr GROUP BY ALL)
SELECT n, round((up - down) / n, 9) AS delta, round(list_sort(list(s))[250] / n, 9) AS low, round(list_sort(list(s))[9750] / n, 9) AS high FROM m GROUP BY n, up, down""")
def _(spark, d):
    return E.bootstrap(E.paired(predictions(spark, d)))


@query("bootstrap_ci_counts")
def _(spark, d):
    """The interval by counts of each resample; its draws are a generator's, tests hold it against the draw-by-draw form."""
    return E.bootstrap_counts(E.paired(predictions(spark, d)))


@query("resume_anti", f"{P} SELECT arm, task_id FROM predictions WHERE (arm, task_id) NOT IN (SELECT arm, task_id FROM predictions WHERE batch % 2 = 0)")
def _(spark, d):
    p = predictions(spark, d)
    return p.select("arm", "task_id").join(p.where("batch % 2 = 0").select("arm", "task_id"), ["arm", "task_id"], "left_anti")


@query("journal_resume", f"{P} SELECT arm, count(*) FILTER (batch % 3 = 0) AS done, count(*) FILTER (batch % 3 <> 0) AS pending FROM predictions GROUP BY 1")
def _(spark, d):
    p = predictions(spark, d)
    done = p.where("batch % 3 = 0").select("arm", "task_id", F.lit(1).alias("hit"))
    return p.join(done, ["arm", "task_id"], "left").groupBy("arm").agg(F.count("hit").alias("done"), F.count_if(F.col("hit").isNull()).alias("pending"))


@query("arm_cross", "SELECT arm, item_id FROM benchmark, (VALUES ('base'), ('sft')) a(arm)")
def _(spark, d):
    return table(spark, d, "benchmark").select(F.explode(F.array(F.lit("base"), F.lit("sft"))).alias("arm"), "item_id")


@query("group_expand", "SELECT item_id, copy, item_id || '-' || copy AS env_id FROM benchmark, range(0, 4) r(copy)")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("copy")).withColumn("env_id", F.concat_ws("-", F.col("item_id").cast("string"), F.col("copy").cast("string")))


@query("batch_ids", "SELECT batch, count(*) AS n, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY doc_id)) AS digest FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch FROM documents) GROUP BY 1")
def _(spark, d):
    from ..operators.numbering import number_rows

    rows = number_rows(table(spark, d, "documents").select("doc_id"), F.floor(F.col("doc_id") / 65536), [F.col("doc_id")], "r")
    rows = rows.withColumn("batch", F.floor((F.col("r") - 1) / 8).cast("long"))
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), "\n"), 256).alias("digest"))


@query("eval_preflight_checks", f"{P} SELECT count(*) > 0 AS has_rows, count(*) = count(DISTINCT arm || ':' || task_id) AS ids_unique, bool_and(output_tokens > 0) AS tokens_positive, count(DISTINCT arm) = 2 AS two_arms FROM predictions")
def _(spark, d):
    one = predictions(spark, d).groupBy("arm", "task_id").agg(F.count(F.lit(1)).alias("n"), F.min("output_tokens").alias("t"))
    return one.agg((F.count(F.lit(1)) > 0).alias("has_rows"), (F.max("n") == 1).alias("ids_unique"), F.bool_and(F.col("t") > 0).alias("tokens_positive"), (F.countDistinct("arm") == 2).alias("two_arms"))


@query("run_diff_full_outer", f"""{P}, l AS (SELECT task_id, status FROM predictions WHERE arm = 'base' AND task_id % 5 <> 0), r AS (SELECT task_id, status FROM predictions WHERE arm = 'sft' AND task_id % 7 <> 0), j AS (SELECT l.task_id AS a, r.task_id AS b, l.status AS x, r.status AS y FROM l FULL JOIN r ON l.task_id = r.task_id)
SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS common, count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right, count(*) FILTER (x <> y) AS changed, count(*) FILTER (a IS NULL OR b IS NULL) = 0 AS same_set, (SELECT list(a)[1:20] FROM (SELECT a FROM j WHERE x <> y ORDER BY a LIMIT 20)) AS first_changed FROM j""")
def _(spark, d):
    p = predictions(spark, d)
    left = p.where("arm = 'base' and task_id % 5 <> 0").select(F.col("task_id").alias("a"), F.col("status").alias("x"))
    right = p.where("arm = 'sft' and task_id % 7 <> 0").select(F.col("task_id").alias("b"), F.col("status").alias("y"))
    j = left.join(right, F.col("a") == F.col("b"), "full")
    sums = j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"), F.count_if(F.col("x") != F.col("y")).alias("changed"), (F.count_if(F.col("a").isNull() | F.col("b").isNull()) == 0).alias("same_set"))
    first = j.where("x <> y").select("a").orderBy("a").limit(20).agg(F.array_sort(F.collect_list("a")).alias("first_changed"))
    return sums.join(first)


@query("fifo_buffer", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 10000")
def _(spark, d):
    return table(spark, d, "events").select("event_id").orderBy(F.desc("event_id")).limit(10000)


# --- groups and rewards -------------------------------------------------------------------------------------------


@query("group_advantages", f"WITH {ROLLOUTS}, s AS (SELECT group_id, avg(reward) AS m, stddev_pop(reward) AS s, min(reward) < max(reward) AS effective FROM rollouts GROUP BY 1) SELECT r.group_id, event_id, reward, effective, round(CASE WHEN effective THEN (reward - m) / (s + 1e-6) ELSE 0 END, 9) AS advantage FROM rollouts r JOIN s USING (group_id)")
def _(spark, d):
    return R.group_advantages(rollouts(spark, d), "group_id", "reward").select("group_id", "event_id", "reward", "effective", F.round("advantage", 9).alias("advantage"))


@query("group_health", f"WITH {ROLLOUTS}, g AS (SELECT group_id, min(reward) AS lo, max(reward) AS hi FROM rollouts GROUP BY 1) SELECT count(*) AS n_groups, count(*) FILTER (hi = 0) AS all_zero, count(*) FILTER (lo = 1) AS all_one, count(*) FILTER (lo < hi) AS effective, count(*) FILTER (lo < hi) AS mixed, round(count(*) FILTER (lo < hi) / count(*), 9) AS effective_rate FROM g")
def _(spark, d):
    return R.group_health(rollouts(spark, d), "group_id", "reward")


@query("mixed_policy_groups", f"WITH {ROLLOUTS} SELECT group_id, count(DISTINCT policy_version) AS versions FROM rollouts GROUP BY 1 HAVING count(DISTINCT policy_version) > 1")
def _(spark, d):
    return rollouts(spark, d).groupBy("group_id").agg(F.countDistinct("policy_version").alias("versions")).where("versions > 1")


@query("rollout_summary", f"WITH {TRACES}, u AS (SELECT trace_id, count(*) AS events, sum(CASE WHEN kind IN ('tool_call', 'invalid_action', 'final') THEN 1 ELSE 0 END) AS steps, max_by(kind, sequence) AS last FROM traces GROUP BY 1) SELECT last AS termination, count(*) AS traces, round(avg(steps), 9) AS mean_steps, round(stddev_pop(steps), 9) AS std_steps, sum(events)::BIGINT AS events FROM u GROUP BY 1")
def _(spark, d):
    u = traces(spark, d).groupBy("trace_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("kind").isin(*T.STEPS)).alias("steps"), F.max_by("kind", "sequence").alias("last"))
    return u.groupBy(F.col("last").alias("termination")).agg(F.count(F.lit(1)).alias("traces"), F.round(F.avg("steps"), 9).alias("mean_steps"), F.round(F.stddev_pop("steps"), 9).alias("std_steps"), F.sum("events").alias("events"))


def _reward_sql(w: R.Weights) -> str:
    return f"""WITH {TRACES}, u AS (SELECT trace_id, bool_or(kind = 'final') AS ok, sum((kind = 'tool_call')::INTEGER) AS tools, CAST(sum(CASE WHEN kind = 'tool_result' THEN CAST(seconds AS DECIMAL(18,6)) ELSE 0 END) AS DOUBLE) AS secs, sum((kind = 'invalid_action')::INTEGER) AS invalid, sum(CASE WHEN kind = 'model_output' THEN tokens ELSE 0 END) AS tokens FROM traces GROUP BY 1)
SELECT trace_id, round(greatest(least(ok::INTEGER * (1.0 - CASE WHEN ok THEN {w.tool} * (tools / 4) ELSE 0 END - CASE WHEN ok THEN {w.python} * (secs / 10.0) ELSE 0 END) - {w.invalid} * least(invalid, {w.invalid_cap}) - ok::INTEGER * CASE WHEN ok THEN {w.token} * (tokens / 1000) ELSE 0 END, {w.high}), {w.low})::DOUBLE, 9) AS reward FROM u"""


def _reward_query(name: str) -> None:
    @query(f"reward_{name}", _reward_sql(R.PRESETS[name]))
    def _(spark, d):
        ok = traces(spark, d).groupBy("trace_id").agg(F.bool_or(F.col("kind") == "final").alias("ok"), *[c.alias(n) for n, c in T.usage_columns().items()])
        r = R.reward(R.PRESETS[name], F.col("ok"), F.col("tool_calls"), F.col("python_seconds"), F.col("invalid_actions"), F.col("generated_tokens"), F.lit(4), F.lit(10.0), F.lit(1000))
        return ok.select("trace_id", F.round(r["total"], 9).alias("reward"))


for _name in R.PRESETS:
    _reward_query(_name)


# --- traces -------------------------------------------------------------------------------------------------------

_USAGE = "sum((kind IN ('tool_call', 'invalid_action', 'final'))::BIGINT)::BIGINT AS steps, sum((kind = 'tool_call')::BIGINT)::BIGINT AS tool_calls, sum((kind = 'invalid_action')::BIGINT)::BIGINT AS invalid_actions, sum(CASE WHEN kind = 'model_output' THEN tokens ELSE 0 END)::BIGINT AS generated_tokens, CAST(sum(CASE WHEN kind = 'tool_result' THEN CAST(seconds AS DECIMAL(18,6)) ELSE 0 END) AS DOUBLE) AS python_seconds"


@query("trace_usage", f"WITH {TRACES} SELECT trace_id, {_USAGE} FROM traces GROUP BY 1")
def _(spark, d):
    return T.usage(traces(spark, d))


@query("trace_running_usage", f"WITH {TRACES} SELECT trace_id, sequence, sum((kind IN ('tool_call', 'invalid_action', 'final'))::BIGINT) OVER w::BIGINT AS steps, sum(CASE WHEN kind = 'model_output' THEN tokens ELSE 0 END) OVER w::BIGINT AS generated_tokens FROM traces WINDOW w AS (PARTITION BY trace_id ORDER BY sequence ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    columns = T.usage_columns(Window.partitionBy("trace_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return traces(spark, d).select("trace_id", "sequence", columns["steps"].alias("steps"), columns["generated_tokens"].alias("generated_tokens"))


_ORDER = f"WITH {TRACES}, m AS (SELECT *, sequence <> row_number() OVER w - 1 AS gap, monotonic_ms < coalesce(lag(monotonic_ms) OVER w, -1) AS back FROM traces WINDOW w AS (PARTITION BY trace_id ORDER BY sequence)), o AS (SELECT trace_id, count(*) AS events, NOT bool_or(gap) AS sequence_ok, NOT bool_or(back) AS time_ok FROM m GROUP BY 1)"


@query("trace_order_check", f"{_ORDER} SELECT * FROM o")
def _(spark, d):
    return T.order_check(traces(spark, d))


@query("trace_replay", f"{_ORDER}, u AS (SELECT trace_id, {_USAGE}, max_by(monotonic_ms, sequence) FILTER (kind = 'final') AS final_ms FROM traces GROUP BY 1) SELECT trace_id, CASE WHEN NOT sequence_ok THEN 'sequence' WHEN NOT time_ok THEN 'time' ELSE 'ok' END AS verdict, steps, tool_calls, invalid_actions, generated_tokens, python_seconds, final_ms FROM o JOIN u USING (trace_id)")
def _(spark, d):
    return T.replay(traces(spark, d))


_EPISODE = f"""WITH RECURSIVE {TRACES}, e AS (SELECT trace_id, kind, seconds, row_number() OVER (PARTITION BY trace_id ORDER BY sequence) AS k, count(*) OVER (PARTITION BY trace_id) AS n FROM traces),
f AS (SELECT trace_id, 0::BIGINT AS k, 0::BIGINT AS steps, 0::BIGINT AS tool_calls, 0::BIGINT AS invalid_actions, 0.0::DOUBLE AS python_seconds, NULL::VARCHAR AS reason FROM (SELECT DISTINCT trace_id FROM e)
 UNION ALL SELECT f.trace_id, e.k, ns, f.tool_calls + (reason IS NULL AND kind = 'tool_call' AND f.tool_calls < {{tools}})::BIGINT, f.invalid_actions + (reason IS NULL AND (kind = 'invalid_action' OR kind = 'tool_call' AND f.tool_calls >= {{tools}}))::BIGINT, nsec,
  CASE WHEN reason IS NOT NULL THEN reason WHEN kind = 'final' THEN 'final' WHEN kind <> 'model_output' AND ns >= {{steps}} THEN 'max_steps' WHEN kind <> 'model_output' AND nsec > 0 AND nsec >= {{seconds}} THEN 'python_time_budget' END
 FROM f JOIN e ON e.trace_id = f.trace_id AND e.k = f.k + 1, LATERAL (SELECT f.steps + (f.reason IS NULL AND e.kind IN ('tool_call', 'invalid_action', 'final'))::BIGINT AS ns, round(f.python_seconds + CASE WHEN f.reason IS NULL AND e.kind = 'tool_result' THEN e.seconds ELSE 0 END, 6) AS nsec))
SELECT f.trace_id, steps, tool_calls, invalid_actions, python_seconds, reason FROM f JOIN (SELECT trace_id, max(k) AS k FROM e GROUP BY 1) z USING (trace_id, k)"""


@query("episode_fold", _EPISODE.format(tools=8, steps=8, seconds=1e9))
def _(spark, d):
    return T.episodes(traces(spark, d), 8, 8, 1e9)


@query("episode_replay", _EPISODE.format(tools=1, steps=2, seconds=0.5))
def _(spark, d):
    return T.episodes(traces(spark, d), 2, 1, 0.5)


@query("conversation_protocol", f"WITH {MESSAGES}, m AS (SELECT *, lag(action) OVER w AS before, row_number() OVER w AS i FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, coalesce(bool_or(i = 1 AND role = 'system'), false) AND coalesce(bool_or(i = 2 AND role = 'user'), false) AS starts_ok, bool_and(role <> 'tool' OR coalesce(before = 'tool', false)) AS tools_ok, coalesce(arg_max_null(action, turn) = 'final', false) AS ends_final FROM m GROUP BY 1")
def _(spark, d):
    return T.conversation_protocol(messages(spark, d))


@query("rollout_terminal", f"WITH {TRACES} SELECT trace_id, max_by(kind = 'final', sequence) AS done_last, sum((kind = 'final')::BIGINT)::BIGINT AS finals FROM traces GROUP BY 1")
def _(spark, d):
    return traces(spark, d).groupBy("trace_id").agg(F.max_by(F.col("kind") == "final", "sequence").alias("done_last"), F.count_if(F.col("kind") == "final").alias("finals"))


@query("hidden_eval", f"WITH {TRACES}, t AS (SELECT trace_id, max_by(tokens, sequence) FILTER (kind = 'final') AS answer FROM traces GROUP BY 1) SELECT trace_id, answer, CASE WHEN answer IS NULL THEN NULL WHEN answer = s_label THEN 'correct' ELSE 'incorrect' END AS verdict FROM t JOIN (SELECT DISTINCT event_id // 4 AS trace_id, 50::BIGINT AS s_label FROM events) USING (trace_id)")
def _(spark, d):
    final = traces(spark, d).groupBy("trace_id").agg(F.max_by(F.when(F.col("kind") == "final", F.col("tokens")), F.when(F.col("kind") == "final", F.col("sequence"))).alias("answer"))
    labels = table(spark, d, "events").select(F.floor(F.col("event_id") / 4).cast("long").alias("trace_id")).distinct().withColumn("label", F.lit(50).cast("long"))
    return final.join(labels, "trace_id").select("trace_id", "answer", F.when(F.col("answer").isNotNull(), F.when(F.col("answer") == F.col("label"), "correct").otherwise("incorrect")).alias("verdict"))


@query("traj_collect", f"WITH {TRACES} SELECT trace_id, string_agg(kind, ',' ORDER BY sequence) AS actions, count(*) AS n FROM traces GROUP BY 1")
def _(spark, d):
    t = traces(spark, d).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "kind"))).alias("e"))
    return t.select("trace_id", F.array_join("e.kind", ",").alias("actions"), F.size("e").cast("long").alias("n"))


@query("trajectory_files", f"WITH {TRACES} SELECT CAST(trace_id AS VARCHAR) AS query, count(*) AS steps, round(sum(seconds), 6) AS total_reward, bool_or(kind = 'final') AS success, string_agg(kind, ',' ORDER BY sequence) AS actions FROM traces GROUP BY 1")
def _(spark, d):
    """Trajectories written as lines and read again; steps and rewards are those of their transitions."""
    from ..sources import older
    from ..storage import new_path

    step = F.struct("sequence", F.to_json(F.struct("sequence")).alias("state"), F.col("kind").alias("action"), F.to_json(F.struct((F.col("sequence") + 1).alias("sequence"))).alias("next_state"), F.col("seconds").alias("reward"), (F.col("kind") == "final").alias("done"), F.lit(None).cast("string").alias("info"))
    t = traces(spark, d).groupBy("trace_id").agg(F.array_sort(F.collect_list(step)).alias("s"), F.bool_or(F.col("kind") == "final").alias("success"))
    steps = F.transform("s", lambda x: F.struct(x["state"].alias("state"), x["action"].alias("action"), x["next_state"].alias("next_state"), x["reward"].alias("reward"), x["done"].alias("done"), x["info"].alias("info")))
    none = F.lit(None).cast("string")
    rows = t.select(F.col("trace_id").cast("string").alias("query"), F.lit("direct").alias("route_decision"), steps.alias("transitions"), none.alias("final_answer"), "success", F.lit(99.0).alias("total_reward"), F.lit(99).cast("long").alias("steps"), none.alias("timestamp"), none.alias("metadata"))
    path = new_path(spark, "trajectories")
    older.write_trajectories(rows, path)
    found = older.read_trajectories(spark, path)
    return found.select("query", "steps", F.round("total_reward", 6).alias("total_reward"), "success", F.array_join("transitions.action", ",").alias("actions"))


@query("last_active_success", f"WITH {TRACES} SELECT trace_id, max_by(kind = 'final', sequence) AS won FROM traces WHERE kind <> 'model_output' GROUP BY 1")
def _(spark, d):
    return traces(spark, d).where("kind <> 'model_output'").groupBy("trace_id").agg(F.max_by(F.col("kind") == "final", "sequence").alias("won"))


@query("rollout_fixed_width", f"WITH {TRACES}, g AS (SELECT t.trace_id, s.step FROM (SELECT DISTINCT trace_id FROM traces) t, range(0, 4) s(step)), l AS (SELECT trace_id, min(sequence) FILTER (kind = 'final') AS stop FROM traces GROUP BY 1) SELECT g.trace_id, g.step, coalesce(tr.kind, 'noop') AS kind, coalesce(g.step <= stop, true) AND tr.kind IS NOT NULL AS active FROM g JOIN l USING (trace_id) LEFT JOIN traces tr ON tr.trace_id = g.trace_id AND tr.sequence = g.step")
def _(spark, d):
    t = traces(spark, d)
    one = t.groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("sequence").cast("long"), "kind"))).alias("m"), F.min(F.when(F.col("kind") == "final", F.col("sequence"))).alias("stop"))
    wide = one.select("trace_id", "stop", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("step")).withColumn("k", F.try_element_at("m", F.col("step")))
    return wide.select("trace_id", "step", F.coalesce("k", F.lit("noop")).alias("kind"), (F.coalesce(F.col("step") <= F.col("stop"), F.lit(True)) & F.col("k").isNotNull()).alias("active"))


@query("traj_stats", f"WITH {TRACES}, u AS (SELECT trace_id, bool_or(kind = 'final') AS ok, count(*) AS n FROM traces GROUP BY 1) SELECT count(*) AS trajectories, round(100.0 * avg(ok::INTEGER), 9) AS success_percent, round(avg(n), 9) AS mean_steps FROM u")
def _(spark, d):
    u = traces(spark, d).groupBy("trace_id").agg(F.bool_or(F.col("kind") == "final").alias("ok"), F.count(F.lit(1)).alias("n"))
    return u.agg(F.count(F.lit(1)).alias("trajectories"), F.coalesce(F.round(100 * F.avg(F.col("ok").cast("double")), 9), F.lit(0.0)).alias("success_percent"), F.coalesce(F.round(F.avg("n"), 9), F.lit(0.0)).alias("mean_steps"))


@query("traj_filter", f"WITH {TRACES} SELECT trace_id FROM traces GROUP BY 1 HAVING bool_or(kind = 'final')")
def _(spark, d):
    return traces(spark, d).where("kind = 'final'").select("trace_id").distinct()


@query("traj_states", f"WITH {TRACES}, e AS (SELECT trace_id, list(kind ORDER BY sequence) AS k FROM traces GROUP BY 1) SELECT trace_id, array_to_string(k, '>') AS states, k[1:len(k) - 1] AS actions FROM e")
def _(spark, d):
    e = traces(spark, d).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "kind"))).alias("e")).select("trace_id", F.col("e.kind").alias("k"))
    return e.select("trace_id", F.array_join("k", ">").alias("states"), F.slice("k", F.lit(1), F.size("k") - 1).alias("actions"))


@query("trace_task_join", f"WITH {TRACES} SELECT t.trace_id, count(*) AS events, any_value(c.c_name) AS customer FROM traces t JOIN customer c ON c.c_custkey = t.user_id GROUP BY t.trace_id, c.c_custkey")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("customer"))
    per = traces(spark, d).groupBy("trace_id", "user_id").agg(F.count(F.lit(1)).alias("events"))
    return per.join(c, "user_id").select("trace_id", "events", "customer")


@query("health_gates", "WITH h AS (SELECT avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) AS errors, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END) AS clicks FROM events) SELECT list_filter([CASE WHEN errors > 0.02 THEN 'verifier_error_rate' END, CASE WHEN errors > 0.25 THEN 'invalid_action_rate' END, CASE WHEN clicks > 0.10 THEN 'sandbox_timeout_rate' END, CASE WHEN clicks > 0.80 THEN 'ineffective_group_rate' END], lambda x: x IS NOT NULL) AS reasons FROM h")
def _(spark, d):
    rate = lambda t: F.avg((F.col("event_type") == t).cast("double"))
    h = table(spark, d, "events").agg(rate("error").alias("verifier_error_rate"), rate("error").alias("invalid_action_rate"), rate("click").alias("sandbox_timeout_rate"), rate("click").alias("ineffective_group_rate"))
    limits = {"verifier_error_rate": 0.02, "invalid_action_rate": 0.25, "sandbox_timeout_rate": 0.10, "ineffective_group_rate": 0.80}
    return h.select(F.array_compact(F.array(*[F.when((F.col(c) > limit) | F.isnan(c), F.lit(c)) for c, limit in limits.items()])).alias("reasons"))


@query("batch_metrics", f"WITH {ROLLOUTS}, b AS (SELECT group_id // 8 AS batch, avg(reward) AS m, count(*) AS n FROM rollouts GROUP BY 1) SELECT batch, round(m, 9) AS mean_reward, n, round(avg(m) OVER (), 9) AS epoch_mean FROM b")
def _(spark, d):
    b = rollouts(spark, d).groupBy(F.floor(F.col("group_id") / 8).cast("long").alias("batch")).agg(F.avg("reward").alias("m"), F.count(F.lit(1)).alias("n"))
    epoch = b.agg(F.round(F.avg("m"), 9).alias("epoch_mean"))
    return b.join(F.broadcast(epoch)).select("batch", F.round("m", 9).alias("mean_reward"), "n", "epoch_mean")


@query("v1_eval", f"WITH {ROLLOUTS}, g AS (SELECT group_id, sum(reward) AS total, count(*) AS steps FROM rollouts GROUP BY 1) SELECT round(avg(total), 9) AS avg_reward, round(avg(steps), 9) AS avg_steps, round(avg((total > 0)::INTEGER), 9) AS success_rate FROM g")
def _(spark, d):
    g = rollouts(spark, d).groupBy("group_id").agg(F.sum("reward").alias("total"), F.count(F.lit(1)).alias("steps"))
    return g.agg(F.round(F.avg("total"), 9).alias("avg_reward"), F.round(F.avg("steps"), 9).alias("avg_steps"), F.round(F.avg((F.col("total") > 0).cast("double")), 9).alias("success_rate"))


@query("v1_summary", f"WITH {ROLLOUTS}, b AS (SELECT group_id // 8 AS batch, avg(reward) AS m FROM rollouts GROUP BY 1) SELECT round(max_by(m, batch), 9) AS latest, round(max(m), 9) AS best, count(*) AS batches FROM b")
def _(spark, d):
    b = rollouts(spark, d).groupBy(F.floor(F.col("group_id") / 8).cast("long").alias("batch")).agg(F.avg("reward").alias("m"))
    return b.agg(F.round(F.max_by("m", "batch"), 9).alias("latest"), F.round(F.max("m"), 9).alias("best"), F.count(F.lit(1)).alias("batches"))


@query("first_last_change", "WITH e AS (SELECT user_id, min_by(value, event_id) AS f, max_by(value, event_id) AS l FROM events GROUP BY 1) SELECT user_id, f AS first_value, l AS last_value, round(CASE WHEN f <> 0 THEN (l - f) / f * 100 END, 6) AS change_percent FROM e")
def _(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.min_by("value", "event_id").alias("first_value"), F.max_by("value", "event_id").alias("last_value"))
    return e.withColumn("change_percent", F.round(F.when(F.col("first_value") != 0, (F.col("last_value") - F.col("first_value")) / F.col("first_value") * 100), 6))


@query("last_logged_loss", "SELECT user_id, max_by(value, event_id) FILTER (event_type <> 'error') AS loss, count(*) AS records, count(*) FILTER (event_type = 'error') AS rejected FROM events GROUP BY 1")
def _(spark, d):
    ok = F.col("event_type") != "error"
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.when(ok, F.col("value")), F.when(ok, F.col("event_id"))).alias("loss"), F.count(F.lit(1)).alias("records"), F.count_if(~ok).alias("rejected"))


@query("collect_experience", f"WITH {ROLLOUTS} SELECT group_id, event_id, reward, reward AS advantage FROM rollouts")
def _(spark, d):
    return rollouts(spark, d).select("group_id", "event_id", "reward", F.col("reward").alias("advantage"))


@query("tool_registry_errors", f"WITH {TRACES} SELECT trace_id, sequence, CASE WHEN tokens % 5 = 0 THEN 'unknown_tool' WHEN tokens % 3 = 0 THEN 'invalid_arguments' END AS error_code, CASE WHEN tokens % 5 <> 0 AND tokens % 3 <> 0 THEN left('output ' || tokens, 8) END AS output FROM traces WHERE kind = 'tool_call'")
def _(spark, d):
    from ..functions.tools import Registry

    registry = Registry(max_output=8)
    registry.add("echo", F.col("arg").rlike("^[0-9]+$"), F.concat(F.lit("output "), F.col("arg")))
    calls = traces(spark, d).where("kind = 'tool_call'").select("trace_id", "sequence", F.when(F.col("tokens") % 5 == 0, "nothing").otherwise("echo").alias("tool"), F.when(F.col("tokens") % 3 == 0, F.lit("?")).otherwise(F.col("tokens").cast("string")).alias("arg"))
    return calls.withColumn("r", registry.run(F.col("tool"))).select("trace_id", "sequence", "r.error_code", "r.output")
