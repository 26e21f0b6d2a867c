"""Queries over routing rules and the older trajectory format."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import routing as R
from .registry import query
from .views import table

# query texts: documents behind a prefix chosen by id
_PREFIX = ("计算 12 + 30 ", "证明：", "first ", "code ", "为什么 ", "分析 ", "")
ASKED = "asked AS (SELECT doc_id, ['计算 12 + 30 ', '证明：', 'first ', 'code ', '为什么 ', '分析 ', ''][doc_id % 7 + 1] || text AS q, doc_id % 6 AS rounds FROM documents)"


def asked(spark, d):
    prefix = F.element_at(F.array(*[F.lit(p) for p in _PREFIX]), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat(prefix, F.col("text")).alias("q"), (F.col("doc_id") % 6).alias("rounds"))


def analysed(spark, d):
    a = asked(spark, d).withColumn("tokens", R.estimate_tokens(F.col("q"))).withColumn("kind", R.task_type(F.col("q")))
    a = a.withColumn("score", R.complexity(F.col("q"), F.col("tokens"), F.col("kind"), F.col("rounds")))
    return a.withColumn("level", R.level(F.col("score"))).withColumn("confidence", R.confidence(F.col("score"), F.col("tokens")))


def _any(x: str, words) -> str:
    import re

    return f"regexp_matches({x}, '{'|'.join(re.escape(w) for w in words)}')"


_KIND = "CASE " + " ".join(f"WHEN {_any('q', w)} THEN '{n}'" for n, w, _ in R.TYPES) + f" WHEN regexp_matches(q, '{R.ARITHMETIC}') THEN 'calculation' ELSE 'simple_qa' END"
_TYPE_SCORE = "CASE kind " + " ".join(f"WHEN '{n}' THEN {s}::DOUBLE" for n, _, s in R.TYPES) + " WHEN 'calculation' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END"
_HITS = " + ".join(f"contains(lower(q), '{w}')::INTEGER" for w in R.COMPLEX)
ANALYSED = f"""WITH {ASKED}, c AS (SELECT *, len(regexp_extract_all(q, '[\\x{{4e00}}-\\x{{9fff}}]')) AS zh, len(regexp_extract_all(q, '[a-zA-Z]+')) AS en, length(q) AS n, {_KIND} AS kind FROM asked),
t AS (SELECT *, floor(zh * 1.5::DOUBLE + en + (n - zh - en) * 0.5::DOUBLE)::BIGINT AS tokens FROM c),
s AS (SELECT *, round(least(1.0::DOUBLE, CASE WHEN tokens > 1000 THEN 0.3::DOUBLE WHEN tokens > 500 THEN 0.2::DOUBLE WHEN tokens > 250 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + {_TYPE_SCORE} + CASE WHEN rounds >= 5 THEN 0.15::DOUBLE WHEN rounds >= 3 THEN 0.1::DOUBLE WHEN rounds >= 1 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + least(({_HITS}) * 0.05::DOUBLE, 0.15::DOUBLE)), 9) AS score FROM t),
a AS (SELECT doc_id, q, rounds, kind, tokens, score, CASE WHEN score >= 0.7 THEN 'complex' WHEN score >= 0.4 THEN 'medium' ELSE 'simple' END AS level, CASE WHEN round(abs(score - 0.4), 9) < 0.1 OR round(abs(score - 0.7), 9) < 0.1 THEN 0.7::DOUBLE WHEN tokens < 50 OR tokens > 1000 THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END AS confidence FROM s),
r AS (SELECT *, CASE WHEN level = 'simple' AND confidence > 0.85 AND kind IN ('simple_qa', 'calculation') THEN 'direct_turbo' WHEN kind IN ('proof', 'multi_step') THEN 'workflow' WHEN level = 'complex' THEN 'direct_max' WHEN level = 'medium' AND tokens >= 500 THEN 'direct_max' ELSE 'direct_turbo' END AS route FROM a)"""


@query("estimate_tokens", f"{ANALYSED} SELECT doc_id, tokens FROM a")
def _(spark, d):
    return asked(spark, d).select("doc_id", R.estimate_tokens(F.col("q")).alias("tokens"))


@query("classify_task", f"{ANALYSED} SELECT doc_id, kind FROM a")
def _(spark, d):
    return asked(spark, d).select("doc_id", R.task_type(F.col("q")).alias("kind"))


@query("complexity_score", f"{ANALYSED} SELECT doc_id, score FROM a")
def _(spark, d):
    return analysed(spark, d).select("doc_id", "score")


@query("complexity_level", f"{ANALYSED} SELECT doc_id, level, confidence FROM a")
def _(spark, d):
    return analysed(spark, d).select("doc_id", "level", "confidence")


def _route():
    return R.route(F.col("kind"), F.col("level"), F.col("confidence"), F.col("tokens"))


@query("route_decision", f"{ANALYSED} SELECT doc_id, route, CASE rounds WHEN 0 THEN 'direct_max' WHEN 1 THEN 'workflow' ELSE route END AS forced FROM r")
def _(spark, d):
    wanted = F.when(F.col("rounds") == 0, "MAX").when(F.col("rounds") == 1, "workflow").when(F.col("rounds") == 2, "other")
    return analysed(spark, d).select("doc_id", _route().alias("route"), R.route(F.col("kind"), F.col("level"), F.col("confidence"), F.col("tokens"), wanted).alias("forced"))


@query("route_stats", f"{ANALYSED} SELECT count(*) AS total, count(*) FILTER (route = 'direct_turbo') AS turbo, count(*) FILTER (route = 'workflow') AS workflow, printf('%.1f%%', count(*) FILTER (route = 'direct_turbo') * 100.0 / count(*)) AS turbo_ratio FROM r")
def _(spark, d):
    r = analysed(spark, d).select(_route().alias("route"))
    stats = r.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("route") == "direct_turbo").alias("turbo"), F.count_if(F.col("route") == "workflow").alias("workflow"))
    return stats.withColumn("turbo_ratio", F.format_string("%.1f%%", F.col("turbo") * 100.0 / F.col("total")))


_PLAN = "CASE " + " ".join(f"WHEN regexp_matches(q, '(?i){p}') THEN '{n}'" for n, p in R.PLAN_PATTERNS) + " ELSE 'general' END"
_GOAL = "CASE plan " + " ".join(f"WHEN '{n}' THEN '{g}'" for n, g in R.PLAN_GOALS.items()) + " END"


@query("plan_classify", f"WITH {ASKED}, p AS (SELECT doc_id, {_PLAN} AS plan FROM asked) SELECT doc_id, plan, {_GOAL} AS goal FROM p")
def _(spark, d):
    goals = F.create_map(*[F.lit(x) for p in R.PLAN_GOALS.items() for x in p])
    return asked(spark, d).withColumn("plan", R.plan_type(F.col("q"))).select("doc_id", "plan", F.element_at(goals, F.col("plan")).alias("goal"))


_TOOL = "CASE " + " ".join(f"WHEN {_any('lower(q)', w)} THEN '{n}'" for n, w in R.TOOLS) + " ELSE 'calculator' END"


@query("tool_select", f"WITH {ASKED}, RECURSIVE_FREE AS (SELECT doc_id, {_TOOL} AS tool, (doc_id % 20)::INTEGER AS n FROM asked) SELECT doc_id, tool, CASE WHEN n = 0 THEN 0 ELSE round((pow((1 + sqrt(5)) / 2, n + 2) - pow((1 - sqrt(5)) / 2, n + 2)) / sqrt(5))::BIGINT - 1 END AS fibonacci FROM RECURSIVE_FREE")
def _(spark, d):
    return asked(spark, d).select("doc_id", R.select_tool(F.col("q")).alias("tool"), R.fibonacci_sum((F.col("doc_id") % 20).cast("int")).alias("fibonacci"))


_RESULTS = "results AS (SELECT conv_id, list(text ORDER BY turn) AS res, count(*) AS n FROM conversations GROUP BY 1)"
_ERR, _WARN, _SUC = R.CRITIC_ERROR, R.CRITIC_WARNING, R.CRITIC_SUCCESS


@query("critic_verdict", f"""WITH {_RESULTS} SELECT conv_id, CASE WHEN regexp_matches(lower(res[n]), '{_ERR}') THEN 'rejected' WHEN regexp_matches(lower(res[n]), '{_WARN}') THEN 'needs_improvement' ELSE 'approved' END AS last_verdict,
CASE WHEN len(list_filter(res, lambda x: regexp_matches(lower(x), '{_ERR}'))) > 0 THEN 'rejected' WHEN n < 4 OR len(list_filter(res, lambda x: x IS NULL OR x = '')) > 0 THEN 'needs_improvement' ELSE 'approved' END AS verdict FROM results""")
def _(spark, d):
    r = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m")).select("conv_id", F.col("m.text").alias("r"))
    return r.select("conv_id", R.critic_one(F.element_at("r", -1)).alias("last_verdict"), R.critic_all(F.col("r"), F.lit(4)).alias("verdict"))


@query("assemble_answer", """WITH s AS (SELECT conv_id, string_agg((turn + 1) || '. ' || role || ': ' || text, chr(10) ORDER BY turn) AS steps, max_by(text, turn) AS last FROM conversations GROUP BY 1)
SELECT conv_id, '## 回答' || chr(10) || chr(10) || steps || chr(10) || '**结论**: ' || last AS answer FROM s""")
def _(spark, d):
    step = F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), F.col("role"), F.lit(": "), F.col("text"))
    s = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", step.alias("line"), "text"))).alias("m"))
    return s.select("conv_id", F.concat(F.lit("## 回答\n\n"), F.array_join("m.line", "\n"), F.lit("\n**结论**: "), F.element_at("m", -1)["text"]).alias("answer"))


@query("format_messages", "WITH s AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY 1) SELECT conv_id, '**执行步骤**:' || chr(10) || array_to_string(list_transform(r, lambda x, i: i || '. ' || x), chr(10)) AS message FROM s")
def _(spark, d):
    s = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"))
    lines = F.transform("m", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["role"]))
    return s.select("conv_id", F.concat(F.lit("**执行步骤**:\n"), F.array_join(lines, "\n")).alias("message"))


@query("text_number_mean", "WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\\d{1,9}'), lambda x: x::BIGINT) AS v FROM documents) SELECT doc_id, len(v)::BIGINT AS n, round(list_avg(v), 6) AS mean FROM n")
def _(spark, d):
    v = table(spark, d, "documents").select("doc_id", F.transform(F.regexp_extract_all("text", F.lit(r"(\d{1,9})"), F.lit(1)), lambda x: x.cast("long")).alias("v"))
    total = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x)
    return v.select("doc_id", F.size("v").cast("long").alias("n"), F.when(F.size("v") > 0, F.round(total / F.size("v"), 6)).alias("mean"))


@query("status_transition", """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' AND event_id % 3 = 2 THEN 'failed' WHEN event_type = 'error' THEN 'retrying' WHEN event_type = 'signup' THEN 'planning' ELSE 'executing' END AS status FROM events""")
def _(spark, d):
    from ..operators.workflow import next_status

    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "tool_ok", "click", "tool_ok", "signup", "planned", "error", "tool_error", "purchase", "answered")]), F.col("event_type"))
    return table(spark, d, "events").select("event_id", next_status(kind, (F.col("event_id") % 3).cast("int"), 2).alias("status"))


@query("workflow_fold")
def _(spark, d):
    from ..operators.workflow import workflow

    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", "tool_ok").when(F.col("role") == "system", "planned").otherwise("answered").alias("event"))
    return workflow(c, "conv_id", "turn", "event")


# --- rewards of the older format

_T = """v1 AS (SELECT d.doc_id, (quality = 1) AS success, ['计算 12 + 30 ', '证明：', 'first '][d.doc_id % 3 + 1] || lang AS q, text AS a, d.doc_id % 9 AS steps, d.doc_id % 5 AS tools, d.doc_id % 4 AS errors FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _v1(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    prefix = F.element_at(F.array(*[F.lit(p) for p in _PREFIX[:3]]), (F.col("doc_id") % 3 + 1).cast("int"))
    return both.select("doc_id", (F.col("quality") == 1).alias("success"), F.concat(prefix, F.col("lang")).alias("q"), F.col("text").alias("a"), *[(F.col("doc_id") % k).alias(n) for n, k in (("steps", 9), ("tools", 5), ("errors", 4))])


_ACC = "(CASE WHEN success THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END + CASE WHEN contains(q, '计算') AND regexp_matches(a, '\\d+') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN contains(q, '证明') AND regexp_matches(a, '证明|因为|所以|因此') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN length(a) BETWEEN 50 AND 500 THEN 0.1::DOUBLE ELSE 0 END)"
_EFF = "((CASE WHEN steps = 0 THEN 0.0::DOUBLE WHEN steps <= 5 THEN 1 ELSE greatest(0, 1 - (steps - 5) / 10.0::DOUBLE) END + CASE WHEN tools <= 2 THEN 1.0::DOUBLE ELSE greatest(0, 1 - (tools - 2) / 5.0::DOUBLE) END) / 2 * 0.5::DOUBLE)"
_SAFE = "(greatest(0, 1.0::DOUBLE - errors * 0.2::DOUBLE - CASE WHEN tools % 2 = 0 THEN 0.1::DOUBLE ELSE 0 END) * 0.3::DOUBLE)"
_CONS = "(len(list_filter(regexp_extract_all(q, '[\\p{L}\\p{N}_]+'), lambda w: contains(lower(a), lower(w)))) / len(regexp_extract_all(q, '[\\p{L}\\p{N}_]+'))::DOUBLE * 0.2::DOUBLE)"


def _parts():
    states = F.when(F.col("tools") % 2 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return {"v1_accuracy": R.accuracy(F.col("success"), F.col("q"), F.col("a")), "v1_efficiency": R.efficiency(F.col("steps"), F.col("tools")), "v1_safety": R.safety(F.col("errors"), states), "v1_consistency": R.consistency(F.col("q"), F.col("a"))}


def _v1_query(name: str, sql: str) -> None:
    @query(name, f"WITH {_T} SELECT doc_id, round({sql}, 9) AS reward FROM v1")
    def _(spark, d):
        return _v1(spark, d).select("doc_id", F.round(_parts()[name], 9).alias("reward"))


for _name, _sql in (("v1_accuracy", _ACC), ("v1_efficiency", _EFF), ("v1_safety", _SAFE), ("v1_consistency", _CONS)):
    _v1_query(_name, _sql)


@query("v1_reward", f"WITH {_T} SELECT doc_id, round({_ACC} + {_EFF} + {_SAFE} + {_CONS}, 9) AS reward FROM v1")
def _(spark, d):
    p = _parts()
    return _v1(spark, d).select("doc_id", F.round(p["v1_accuracy"] + p["v1_efficiency"] + p["v1_safety"] + p["v1_consistency"], 9).alias("reward"))


# --- grade-school problems

_G = "g AS (SELECT doc_id, 'so ' || lang || ' #### ' || (n_chars % 1000) AS answer, source AS category FROM documents)"


def _grade(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("so "), F.col("lang"), F.lit(" #### "), (F.col("n_chars") % 1000).cast("string")).alias("answer"), F.col("source").alias("category"))


@query("gsm8k_value", f"WITH {_G} SELECT doc_id, trim(split_part(answer, '####', 1)) AS solution, regexp_extract(answer, '####\\s*(-?\\d+\\.?\\d*)', 1)::DOUBLE AS value FROM g")
def _(spark, d):
    from ..functions.grade import solution, value

    return _grade(spark, d).select("doc_id", solution(F.col("answer")).alias("solution"), value(F.col("answer")).alias("value"))


@query("gsm8k_format", f"WITH {_G} SELECT doc_id AS id, category, answer AS response, regexp_extract(answer, '####\\s*(-?\\d+\\.?\\d*)', 1)::DOUBLE AS target FROM g")
def _(spark, d):
    from ..functions.grade import value

    return _grade(spark, d).select(F.col("doc_id").alias("id"), "category", F.col("answer").alias("response"), value(F.col("answer")).alias("target"))


@query("gsm8k_stats", f"WITH {_G} SELECT category, count(*) AS n, round(avg(length(answer)), 9) AS mean_length FROM g GROUP BY 1")
def _(spark, d):
    return _grade(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("answer")), 9).alias("mean_length"))
