"""Inputs of the queries: the tables of a folder, and views derived from them the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Raw problem rows of all sources: (dataset, intended_use, row_id, problem, answer), some without problem or answer."""
    docs = table(spark, d, "documents")
    problem = F.when(F.col("doc_id") % 17 == 0, F.lit("  ")).otherwise(F.col("text")).alias("problem")
    answer = F.when(F.col("doc_id") % 19 == 0, F.lit(None)).otherwise(F.col("n_chars").cast("string")).alias("answer")
    train = docs.select(F.col("source").alias("dataset"), F.lit("train").alias("intended_use"), F.col("doc_id").alias("row_id"), problem, answer)
    held = docs.where("doc_id % 10 = 0").select(F.lit("holdout").alias("dataset"), F.lit("eval").alias("intended_use"), F.col("doc_id").alias("row_id"), problem, answer)
    bench = table(spark, d, "benchmark").select(F.lit("benchmark").alias("dataset"), F.lit("eval").alias("intended_use"), F.col("item_id").alias("row_id"), F.col("text").alias("problem"), F.col("item_id").cast("string").alias("answer"))
    return train.unionByName(held).unionByName(bench)


RECORDS = """records AS (
  SELECT source AS dataset, 'train' AS intended_use, doc_id AS row_id, CASE WHEN doc_id % 17 = 0 THEN '  ' ELSE text END AS problem, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE CAST(n_chars AS VARCHAR) END AS answer FROM documents
  UNION ALL
  SELECT 'holdout', 'eval', doc_id, CASE WHEN doc_id % 17 = 0 THEN '  ' ELSE text END, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE CAST(n_chars AS VARCHAR) END FROM documents WHERE doc_id % 10 = 0
  UNION ALL
  SELECT 'benchmark', 'eval', item_id, text, CAST(item_id AS VARCHAR) FROM benchmark
)"""

# canonical text, source hash, task id and route of each record
CANON = RECORDS + """, canon AS (
  SELECT *, trim(regexp_replace(problem, '\\s+', ' ', 'g')) AS canonical, sha256(coalesce(dataset, '') || chr(31) || row_id || chr(31) || coalesce(problem, '') || chr(31) || coalesce(answer, '')) AS source_hash FROM records
), routed AS (
  SELECT *, dataset || ':' || left(sha256(canonical), 20) AS task_id, sha256(canonical) AS content_key,
    CASE WHEN problem IS NULL OR canonical = '' THEN 'missing_problem' WHEN answer IS NULL OR trim(answer) = '' THEN 'missing_answer' WHEN NOT regexp_full_match(answer, '[+-]?\\d+') THEN 'unverifiable_reference' ELSE 'kept' END AS route FROM canon
), tasks AS (SELECT * FROM routed WHERE route = 'kept')"""

# one task for each content key (held-out data first, then the smallest id), and the splits over them
KEPT = CANON + """, winners AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_key ORDER BY intended_use = 'train', task_id, row_id) AS k FROM tasks) WHERE k = 1
)"""
SPLITS = KEPT + """, ranked AS (
  SELECT task_id, dataset, intended_use, row_number() OVER (ORDER BY md5('7:' || task_id), task_id) AS r FROM winners WHERE intended_use = 'train'
), sizes AS (SELECT count(*) AS n FROM ranked), splits AS (
  SELECT task_id, dataset, CASE WHEN r <= round_even(n * 0.9, 0) THEN 'train' WHEN r <= round_even(n * 0.9, 0) + round_even(n * 0.05, 0) THEN 'sft_dev' ELSE 'rl_dev' END AS split FROM ranked, sizes
  UNION ALL SELECT task_id, dataset, 'frozen_eval' FROM winners WHERE intended_use = 'eval'
)"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Answer strings in eight forms with their references: (form, q, n, raw, reference)."""
    q, n = F.col("q"), F.col("n")
    base = table(spark, d, "lineitem").select(((F.col("l_orderkey") + F.col("l_linenumber")) % 8).cast("int").alias("form"), F.col("l_quantity").cast("int").alias("q"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag")).distinct()
    tag = lambda x: F.concat(F.lit('<final>{"answer": "'), x.cast("string"), F.lit('"}</final>'))
    forms = [tag(q), F.concat(tag(q), F.lit(" "), tag(n)), F.concat(F.lit("answer: "), q.cast("string")), F.concat(F.lit("\\boxed{"), q.cast("string"), F.lit("}")), F.concat(F.lit("$"), q.cast("string"), F.lit("$")), F.concat(F.lit('<final>{"answer": '), q.cast("string"), F.lit("</final>")), F.concat(q.cast("string"), F.lit("/2")), F.concat(F.lit("1,"), F.lpad(q.cast("string"), 3, "0"))]
    raw = F.element_at(F.array(*forms), F.col("form") + 1)
    reference = F.when(F.col("flag") == "R", q + 1).otherwise(q).cast("string")
    return base.withColumn("raw", raw).withColumn("reference", reference).select("form", "q", "n", "flag", "raw", "reference")


ANSWERS = """answers AS (
  SELECT form, q, n, flag, CASE form
      WHEN 0 THEN '<final>{"answer": "' || q || '"}</final>' WHEN 1 THEN '<final>{"answer": "' || q || '"}</final> <final>{"answer": "' || n || '"}</final>'
      WHEN 2 THEN 'answer: ' || q WHEN 3 THEN '\\boxed{' || q || '}' WHEN 4 THEN '$' || q || '$' WHEN 5 THEN '<final>{"answer": ' || q || '</final>' WHEN 6 THEN q || '/2' ELSE '1,' || lpad(CAST(q AS VARCHAR), 3, '0') END AS raw,
    CAST(CASE WHEN flag = 'R' THEN q + 1 ELSE q END AS VARCHAR) AS reference
  FROM (SELECT DISTINCT CAST((l_orderkey + l_linenumber) % 8 AS INTEGER) AS form, CAST(l_quantity AS INTEGER) AS q, l_linenumber AS n, l_returnflag AS flag FROM lineitem)
)"""

# numbers and collections written from (q, n)
NUMBERS = ANSWERS + """, numbers AS (
  SELECT DISTINCT q, n, form, CASE form WHEN 0 THEN CAST(q AS VARCHAR) WHEN 1 THEN q || '.' || n WHEN 2 THEN q || '/' || n WHEN 3 THEN '1,' || lpad(CAST(q AS VARCHAR), 3, '0') WHEN 4 THEN q || '/0' WHEN 5 THEN q || 'x' WHEN 6 THEN '-' || q ELSE '0.' || q END AS txt FROM answers
)"""


def numbers(spark: SparkSession, d: str) -> DataFrame:
    q, n = F.col("q").cast("string"), F.col("n").cast("string")
    forms = [q, F.concat(q, F.lit("."), n), F.concat(q, F.lit("/"), n), F.concat(F.lit("1,"), F.lpad(q, 3, "0")), F.concat(q, F.lit("/0")), F.concat(q, F.lit("x")), F.concat(F.lit("-"), q), F.concat(F.lit("0."), q)]
    return answers(spark, d).select("q", "n", "form").distinct().withColumn("txt", F.element_at(F.array(*forms), F.col("form") + 1))


def traces(spark: SparkSession, d: str) -> DataFrame:
    """Recorded events: (trace_id, sequence, kind, monotonic_ms, tokens, seconds), some traces with a gap."""
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("trace_id", F.floor(F.col("event_id") / 4).cast("long"))
    w = Window.partitionBy("trace_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = e.withColumn("sequence", (F.row_number().over(w) - 1).cast("int")).withColumn("monotonic_ms", F.floor((micros - F.min(micros).over(Window.partitionBy("trace_id"))) / 1000).cast("long"))
    kind = F.element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.col("event_type"))
    e = e.withColumn("kind", kind).withColumn("tokens", F.get_json_object("props", "$.k").cast("long")).withColumn("seconds", F.round(F.col("value") / 100, 6))
    return e.where("event_id % 97 <> 0").select("trace_id", "sequence", "kind", "monotonic_ms", "tokens", "seconds", "event_id", "user_id")


# event types as trace event kinds
KINDS = {"view": "model_output", "click": "tool_call", "signup": "tool_result", "error": "invalid_action", "purchase": "final"}
TRACES = """traces AS (
  SELECT * EXCLUDE (gone) FROM (
    SELECT event_id // 4 AS trace_id, CAST(row_number() OVER (PARTITION BY event_id // 4 ORDER BY ts, event_id) - 1 AS INTEGER) AS sequence,
      CASE event_type WHEN 'view' THEN 'model_output' WHEN 'click' THEN 'tool_call' WHEN 'signup' THEN 'tool_result' WHEN 'error' THEN 'invalid_action' WHEN 'purchase' THEN 'final' END AS kind,
      CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_id // 4)) / 1000) AS BIGINT) AS monotonic_ms,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, round(value / 100, 6) AS seconds, event_id, user_id, event_id % 97 = 0 AS gone FROM events
  ) WHERE NOT gone
)"""


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    """(group_id, event_id, reward, policy_version)."""
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 4).cast("long").alias("group_id"), "event_id", F.when(F.col("event_type").isin("purchase", "signup"), 1.0).otherwise(0.0).alias("reward"), F.concat(F.lit("v"), (F.col("event_id") % 101 == 0).cast("int").cast("string")).alias("policy_version"))


ROLLOUTS = """rollouts AS (
  SELECT event_id // 4 AS group_id, event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward, 'v' || CAST(event_id % 101 = 0 AS INTEGER) AS policy_version FROM events
)"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Two arms over the labelled documents: (arm, task_id, correct, valid, output_tokens, latency_ms, batch)."""
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "n_chars", "quality", "toxic")
    rows = number_rows(both, F.floor(F.col("doc_id") / 65536), [F.col("doc_id")], "r").withColumn("batch", F.floor((F.col("r") - 1) / 8).cast("long"))
    one = lambda arm, ok: F.struct(F.lit(arm).alias("arm"), ok.alias("correct"))
    rows = rows.withColumn("a", F.explode(F.array(one("base", F.col("quality") == 1), one("sft", F.col("toxic") == 0))))
    status = F.when(F.col("a.correct"), F.lit("correct")).when(F.col("doc_id") % 3 == 0, F.lit("invalid_prediction")).when(F.col("doc_id") % 7 == 0, F.lit("timeout")).when(F.col("doc_id") % 11 == 0, F.lit("invalid_reference")).when(F.col("doc_id") % 13 == 0, F.lit("internal_error")).otherwise(F.lit("incorrect"))
    return rows.select(F.col("a.arm").alias("arm"), F.col("doc_id").alias("task_id"), F.col("a.correct").alias("correct"), status.alias("status"), F.col("n_chars").alias("output_tokens"), (F.col("doc_id") * 37 % 1000 / F.lit(10.0)).alias("latency_ms"), "batch")


PREDICTIONS = """predictions AS (
  SELECT arm, doc_id AS task_id, correct, CASE WHEN correct THEN 'correct' WHEN doc_id % 3 = 0 THEN 'invalid_prediction' WHEN doc_id % 7 = 0 THEN 'timeout' WHEN doc_id % 11 = 0 THEN 'invalid_reference' WHEN doc_id % 13 = 0 THEN 'internal_error' ELSE 'incorrect' END AS status, n_chars AS output_tokens, (doc_id * 37 % 1000) / 10.0::DOUBLE AS latency_ms, batch
  FROM (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch, unnest(['base', 'sft']) AS arm, unnest([quality = 1, toxic = 0]) AS correct FROM documents JOIN labels USING (doc_id))
)"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, turn, role, text, action): the last assistant turn is final, every third turn a tool action."""
    from pyspark.sql import Window

    c = table(spark, d, "conversations")
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return c.withColumn("action", F.when(F.col("turn") == last, F.lit("final")).when(F.col("turn") % 3 == 0, F.lit("tool"))).select("conv_id", "turn", "role", "text", "action")


MESSAGES = """messages AS (
  SELECT conv_id, turn, role, text, CASE WHEN turn = max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) THEN 'final' WHEN turn % 3 = 0 THEN 'tool' END AS action FROM conversations
)"""
