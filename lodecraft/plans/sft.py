"""Queries over training records, diagnostics, sinks and near-duplicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus, sft, similar, tokenize
from ..storage import materialise, new_path
from ..sources.tasks import flatten, read_tasks, write_quarantine, write_tasks
from .corpus import _NEAR, tasks, winners
from .registry import query
from .views import CANON, KEPT, MESSAGES, RECORDS, SPLITS, TRACES, messages, records, table, traces


# Greedy in the order of content keys: one step of the recursion is one task's turn, over the tasks that have a near one.
_GREEDY = _NEAR[: _NEAR.rindex("SELECT a, b, common")] + """, pairs AS (SELECT a, b FROM cnt WHERE common >= (na + nb - common) * 0.9), mutual AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
ranked AS (SELECT task_id, content_key, CAST(CAST(intended_use = 'train' AS INTEGER) AS VARCHAR) || task_id AS rank FROM winners WHERE task_id IN (SELECT a FROM mutual)),
near AS (SELECT a, list({'id': r.task_id, 'rank': r.rank}) AS near FROM mutual JOIN ranked r ON r.task_id = b GROUP BY a),
v AS (SELECT task_id, row_number() OVER (ORDER BY content_key) AS turn, list_append(near, {'id': task_id, 'rank': rank}) AS around FROM ranked JOIN near ON a = task_id),
steps AS (SELECT 0::BIGINT AS turn, []::VARCHAR[] AS gone UNION ALL
  SELECT turn, list_concat(gone, list_filter(list_transform(around, lambda x: CASE WHEN x.rank <> list_min(list_transform(around, lambda y: y.rank)) THEN x.id END), lambda x: x IS NOT NULL)) AS gone
  FROM (SELECT v.turn, s.gone, CASE WHEN list_contains(s.gone, v.task_id) THEN [] ELSE list_filter(v.around, lambda x: NOT list_contains(s.gone, x.id)) END AS around FROM steps s JOIN v ON v.turn = s.turn + 1)),
done AS (SELECT gone FROM steps ORDER BY turn DESC LIMIT 1)
SELECT task_id, dataset, content_key FROM winners WHERE NOT list_contains((SELECT gone FROM done), task_id)"""
_GREEDY = _GREEDY.replace("WITH ", "WITH RECURSIVE ", 1)


@query("near_dedup", _GREEDY)
def _(spark, d):
    return similar.near_dedup(winners(spark, d, ["canonical"]))


@query("near_pairs_lsh", f"""{_NEAR[: _NEAR.rindex("SELECT a, b, common")]}, pairs AS (SELECT a, b FROM cnt WHERE common >= (na + nb - common) * 0.9), met AS (SELECT a AS id, b AS other FROM pairs UNION ALL SELECT b, a FROM pairs),
sets AS (SELECT id, md5(array_to_string(list_sort(list(g)), chr(0))) AS s FROM g GROUP BY 1)
SELECT id, min(id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS copies, (SELECT count(*) FROM met WHERE met.id = sets.id) AS links FROM sets""")
def _(spark, d):
    """At a threshold of 0.9 a pair is missed with a probability of 5e-10, so the rows are those of the exact join."""
    return similar.lsh_links(winners(spark, d, ["canonical"]).select(F.col("task_id").alias("id"), "canonical"))


@query("minhash_sig")
def _(spark, d):
    w = winners(spark, d, ["canonical"]).select(F.col("task_id").alias("id"), "canonical")
    return similar.signatures(w, text.PERMUTATIONS).select(F.col("id").alias("task_id"), "n", F.hex("signature").alias("signature"))


@query("sink_task_parquet")
def _(spark, d):
    path = new_path(spark, "tasks")
    write_tasks(flatten(tasks(spark, d)), path)
    return read_tasks(spark, path).select("task_id", "dataset", "split")


@query("sink_quarantine")
def _(spark, d):
    path = new_path(spark, "quarantine")
    write_quarantine(corpus.route(records(spark, d)).where("route <> 'kept'").select(F.col("dataset").alias("source"), "source_hash", F.col("route").alias("reason")), path)
    return spark.read.schema("source string, source_hash string, reason string").json(path)


@query("sft_blob_roundtrip", f"WITH {CANON} SELECT task_id, dataset, answer FROM tasks")
def _(spark, d):
    blob = tasks(spark, d).select(F.to_json(F.struct("task_id", "dataset", "answer")).alias("record_json"))
    return blob.select(F.from_json("record_json", "task_id string, dataset string, answer string").alias("r")).select("r.*")


@query("diagnostic_rows", f"WITH {RECORDS} SELECT dataset, row_id, answer AS source_answer, right(problem, 1000) AS solution_tail FROM records")
def _(spark, d):
    return records(spark, d).select("dataset", "row_id", F.col("answer").alias("source_answer"), F.right("problem", F.lit(1000)).alias("solution_tail"))


@query("join_source_hash", f"WITH {CANON} SELECT r.dataset, r.row_id, t.task_id, CASE WHEN t.task_id IS NOT NULL THEN 'accepted' ELSE q.route END AS outcome FROM canon r LEFT JOIN tasks t ON r.source_hash = t.source_hash LEFT JOIN (SELECT source_hash, route FROM routed WHERE route <> 'kept') q ON r.source_hash = q.source_hash")
def _(spark, d):
    routed = corpus.route(records(spark, d))
    kept = routed.where("route = 'kept'").select("source_hash", "task_id")
    out = routed.where("route <> 'kept'").select("source_hash", "route")
    joined = routed.select("dataset", "row_id", "source_hash").join(kept, "source_hash", "left").join(out, "source_hash", "left")
    return joined.select("dataset", "row_id", "task_id", F.when(F.col("task_id").isNotNull(), "accepted").otherwise(F.col("route")).alias("outcome"))


@query("task_lookup", f"WITH {CANON}, ids AS (SELECT conv_id, unnest([conv_id, conv_id + 1]) AS row_id FROM (SELECT DISTINCT conv_id FROM conversations)) SELECT i.conv_id, i.row_id, count(t.task_id) AS found FROM ids i LEFT JOIN tasks t USING (row_id) GROUP BY 1, 2")
def _(spark, d):
    ids = table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.array(F.col("conv_id"), F.col("conv_id") + 1)).alias("row_id"))
    return ids.join(tasks(spark, d).select("row_id", "task_id"), "row_id", "left").groupBy("conv_id", "row_id").agg(F.count("task_id").alias("found"))


@query("manifest_diff", "WITH m AS (SELECT count(*) FILTER (doc_id % 2 = 0) AS a_docs, count(*) FILTER (doc_id % 2 = 1) AS b_docs, count(DISTINCT lang) FILTER (doc_id % 2 = 0) AS a_langs, count(DISTINCT lang) FILTER (doc_id % 2 = 1) AS b_langs, sum(n_chars) FILTER (doc_id % 2 = 0)::BIGINT AS a_chars, sum(n_chars) FILTER (doc_id % 2 = 1)::BIGINT AS b_chars FROM documents) SELECT field, a, b FROM (SELECT unnest(['docs', 'langs', 'chars']) AS field, unnest([a_docs, a_langs, a_chars]) AS a, unnest([b_docs, b_langs, b_chars]) AS b FROM m) WHERE a IS DISTINCT FROM b")
def _(spark, d):
    docs, even = table(spark, d, "documents"), F.col("doc_id") % 2 == 0
    parts = {f"{side}_{name}": agg for side, cond in (("a", even), ("b", ~even)) for name, agg in (("docs", F.count_if(cond)), ("langs", F.countDistinct(F.when(cond, F.col("lang")))), ("chars", F.sum(F.when(cond, F.col("n_chars")))))}
    one = docs.agg(*[c.alias(n) for n, c in parts.items()])
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"a_{n}").alias("a"), F.col(f"b_{n}").alias("b")) for n in ("docs", "langs", "chars")])
    return one.select(F.explode(fields).alias("x")).select("x.*").where(~F.col("a").eqNullSafe(F.col("b")))


@query("rejected_counts", f"WITH {CANON} SELECT route AS outcome, count(*) AS n FROM routed WHERE route <> 'kept' GROUP BY 1")
def _(spark, d):
    return corpus.route(records(spark, d)).where("route <> 'kept'").groupBy(F.col("route").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("diagnostic_summary", f"WITH {CANON}, t AS (SELECT count(*) AS total FROM routed) SELECT route AS outcome, count(*) AS n, round(count(*) / any_value(total), 9) AS rate FROM routed, t GROUP BY 1")
def _(spark, d):
    counts = corpus.route(records(spark, d)).groupBy(F.col("route").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("outcome", "n", F.round(F.col("n") / F.col("total"), 9).alias("rate"))


@query("topk_examples", f"WITH {CANON} SELECT route AS outcome, dataset, row_id FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY dataset, row_id) AS k FROM routed) WHERE k <= 3")
def _(spark, d):
    k = F.row_number().over(Window.partitionBy("outcome").orderBy("dataset", "row_id"))
    return corpus.route(records(spark, d)).select(F.col("route").alias("outcome"), "dataset", "row_id").withColumn("k", k).where("k <= 3").drop("k")


@query("first_accepted", f"WITH {KEPT}, r AS (SELECT content_key, dataset, row_id, row_id // 64 AS batch, row_id % 5 <> 0 AS ok FROM tasks), f AS (SELECT *, row_number() OVER (PARTITION BY content_key ORDER BY ok DESC, batch, dataset || ':' || row_id) AS k FROM r) SELECT dataset, row_id, CASE WHEN NOT ok THEN 'rejected' WHEN k = 1 THEN 'accepted' ELSE 'duplicate_task' END AS outcome FROM f")
def _(spark, d):
    t = tasks(spark, d).select("content_key", "dataset", "row_id")
    order = F.concat(F.col("dataset"), F.lit(":"), F.col("row_id").cast("string"))
    return sft.first_accepted(t, "content_key", order, F.col("row_id") % 5 != 0, F.floor(F.col("row_id") / 64)).select("dataset", "row_id", "outcome")


@query("materialise_batches", f"WITH {KEPT}, r AS (SELECT content_key, dataset, row_id, row_id % 4 AS batch, row_id % 5 <> 0 AS ok FROM tasks), f AS (SELECT *, row_number() OVER (PARTITION BY content_key ORDER BY ok DESC, batch, dataset || ':' || row_id) AS k FROM r) SELECT dataset, row_id, batch, CASE WHEN NOT ok THEN 'rejected' WHEN k = 1 THEN 'accepted' ELSE 'duplicate_task' END AS outcome FROM f")
def _(spark, d):
    """Solutions that come in four batches, each judged against the accepted keys of those before; the second is added twice."""
    t = materialise(tasks(spark, d).select("content_key", "dataset", "row_id"), "solutions")
    t = t.withColumn("place", F.concat(F.col("dataset"), F.lit(":"), F.col("row_id").cast("string"))).withColumn("ok", F.col("row_id") % 5 != 0)
    batches = sft.Batches(spark, new_path(spark, "batches"), "content_key", "place", "ok")
    for n in (0, 1, 1, 2, 3):
        batches.add(t.where(F.col("row_id") % 4 == n), n)
    return batches.outcomes().select("dataset", "row_id", F.col("batch").cast("long").alias("batch"), "outcome")


@query("dedup_totals", _GREEDY[: _GREEDY.rindex("SELECT task_id, dataset, content_key")] + "SELECT (SELECT count(*) FROM tasks) AS tasks, (SELECT count(*) FROM tasks) - count(*) AS exact_removed, count(*) FILTER (list_contains((SELECT gone FROM done), task_id)) AS near_removed, count(*) FILTER (NOT list_contains((SELECT gone FROM done), task_id)) AS unique_tasks FROM winners")
def _(spark, d):
    """The manifest's counters of removed duplicates, near ones included."""
    kept = materialise(winners(spark, d, ["canonical"]), "kept")
    left = similar.near_dedup(kept).agg(F.count(F.lit(1)).alias("unique_tasks"))
    sums = kept.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("tasks"), F.count(F.lit(1)).alias("w")).join(left)  # two rows of aggregates
    return sums.select("tasks", (F.col("tasks") - F.col("w")).alias("exact_removed"), (F.col("w") - F.col("unique_tasks")).alias("near_removed"), "unique_tasks")


@query("split_audit_full", f"""WITH {SPLITS}, s AS (SELECT x.split, x.task_id, w.answer FROM splits x JOIN winners w USING (task_id)), c AS (SELECT task_id, count(DISTINCT split) AS splits, bool_or(split <> 'frozen_eval') AS pool FROM s GROUP BY 1)
SELECT split, count(*) AS n, sha256(string_agg(task_id, chr(10) ORDER BY task_id)) AS digest, count(*) - count(DISTINCT task_id) AS repeated, count(*) FILTER (c.splits > 1) AS across, count(*) FILTER (split = 'frozen_eval' AND c.pool) AS leaked, count(*) FILTER (NOT regexp_full_match(answer, '[+-]?[0-9]+')) AS unverifiable FROM s JOIN c USING (task_id) GROUP BY 1""")
def _(spark, d):
    """Each split's digest, repeated and shared ids, leaks of held-out tasks, and references that do not verify against themselves."""
    kept = materialise(winners(spark, d, ["reference_value"]), "kept")
    rows = corpus.assign_splits(kept).join(kept.select("task_id", "reference_value"), "task_id")
    return corpus.audit_splits(rows)


@query("sft_behavior", f"WITH {TRACES}, b AS (SELECT trace_id, sum((kind = 'invalid_action')::INTEGER) AS bad, bool_or(kind = 'tool_result') AS py, bool_or(kind = 'tool_call') AS sy FROM traces GROUP BY 1) SELECT trace_id, CASE WHEN bad > 0 THEN 'recovery' WHEN py THEN 'python' WHEN sy THEN 'sympy' ELSE 'direct' END AS behavior FROM b")
def _(spark, d):
    tool = F.when(F.col("kind") == "tool_result", "python").when(F.col("kind") == "tool_call", "sympy")
    b = traces(spark, d).groupBy("trace_id").agg(F.collect_set(tool).alias("tools"), F.count_if(F.col("kind") == "invalid_action").alias("bad"))
    return b.select("trace_id", sft.behaviour(F.col("tools"), F.col("bad")).alias("behavior"))


@query("sft_audit", f"WITH {TRACES}, b AS (SELECT trace_id, CASE WHEN bool_or(kind = 'invalid_action') THEN 'recovery' WHEN bool_or(kind = 'tool_call') THEN 'sympy' ELSE 'direct' END AS behavior FROM traces GROUP BY 1) SELECT behavior, count(*) AS n, count(*) = count(DISTINCT trace_id) AS ids_unique FROM b GROUP BY 1")
def _(spark, d):
    b = traces(spark, d).groupBy("trace_id").agg(F.bool_or(F.col("kind") == "invalid_action").alias("bad"), F.bool_or(F.col("kind") == "tool_call").alias("tool"))
    b = b.select("trace_id", F.when(F.col("bad"), "recovery").when(F.col("tool"), "sympy").otherwise("direct").alias("behavior"))
    return b.groupBy("behavior", "trace_id").agg(F.count(F.lit(1)).alias("c")).groupBy("behavior").agg(F.sum("c").alias("n"), (F.max("c") == 1).alias("ids_unique"))


@query("sft_manifest", f"WITH {MESSAGES}, c AS (SELECT conv_id, bool_or(action = 'final') AS done, count(*) AS n FROM messages GROUP BY 1) SELECT count(*) AS records, count(*) FILTER (done) AS complete, sum(n)::BIGINT AS messages FROM c")
def _(spark, d):
    c = messages(spark, d).groupBy("conv_id").agg(F.coalesce(F.bool_or(F.col("action") == "final"), F.lit(False)).alias("done"), F.count(F.lit(1)).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("records"), F.count_if("done").alias("complete"), F.sum("n").alias("messages"))


@query("render_conversation", "SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn) AS rendered, count(*) AS n FROM conversations GROUP BY 1")
def _(spark, d):
    return sft.conversations(table(spark, d, "conversations"))


@query("sft_records", f"WITH {MESSAGES} SELECT conv_id, list(role ORDER BY turn) AS roles, max_by(text, turn) FILTER (action = 'final') AS final_text FROM messages GROUP BY 1")
def _(spark, d):
    m = messages(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"), F.max_by(F.when(F.col("action") == "final", F.col("text")), F.when(F.col("action") == "final", F.col("turn"))).alias("final_text"))
    return m.select("conv_id", F.col("m.role").alias("roles"), "final_text")


def _sized(spark, d):
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.size(F.split("text", " ")).alias("n")))).alias("m"))
    return m.select("conv_id", F.col("m.role").alias("roles"), F.col("m.n").alias("sizes"))


_SIZED = "s AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(len(string_split(text, ' ')) ORDER BY turn) AS sizes FROM conversations GROUP BY 1)"


@query("assistant_mask", f"WITH {_SIZED} SELECT conv_id, list_sum(sizes)::BIGINT AS tokens, list_sum(list_transform(list_zip(sizes, roles), lambda x: CASE WHEN x[2] = 'assistant' THEN x[1] ELSE 0 END))::BIGINT AS trained FROM s")
def _(spark, d):
    m = _sized(spark, d).withColumn("mask", sft.assistant_mask(F.col("sizes"), F.col("roles")))
    return m.select("conv_id", F.size("mask").cast("long").alias("tokens"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("trained"))


@query("mask_invariant", f"WITH {_SIZED} SELECT conv_id, list_sum(sizes)::BIGINT AS mask_length, list_sum(sizes) > 0 AS ok FROM s")
def _(spark, d):
    m = _sized(spark, d).withColumn("mask", sft.assistant_mask(F.col("sizes"), F.col("roles")))
    return m.select("conv_id", F.size("mask").cast("long").alias("mask_length"), ((F.size("mask") > 0) & (F.size("mask") == F.aggregate("sizes", F.lit(0), lambda a, x: a + x))).alias("ok"))


@query("prefix_tokens")
def _(spark, d):
    """Tokens, trained tokens and the messages' ends of each conversation; no SQL has the tokenizer, tests compare with encoding every prefix."""
    import public_tokenizers

    rows = tokenize.tokenize(table(spark, d, "conversations"), public_tokenizers.path("byte_bpe_50k.json"), 16384)
    return rows.select("conv_id", F.size("input_ids").cast("long").alias("tokens"), F.aggregate("assistant_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("trained"), F.col("spans.end").alias("ends"), "error")


@query("pad_batch", "WITH s AS (SELECT doc_id, (doc_id % 7 + 1) AS n FROM documents), b AS (SELECT doc_id // 8 AS batch, max(n) AS most FROM s GROUP BY 1) SELECT doc_id, list_concat(range(0, n), list_transform(range(n, most), lambda x: -1)) AS ids FROM s JOIN b ON batch = doc_id // 8")
def _(spark, d):
    s = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 7 + 1).alias("n"), F.floor(F.col("doc_id") / 8).alias("batch"))
    most = s.groupBy("batch").agg(F.max("n").alias("most"))
    ids = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda x: x)
    return s.join(most, "batch").select("doc_id", F.concat(ids, F.array_repeat(F.lit(-1).cast("long"), (F.col("most") - F.col("n")).cast("int"))).alias("ids"))


@query("direct_trace", f"WITH {CANON} SELECT task_id, row_id, ['system', 'user', 'assistant'] AS roles, '<final>{{\"answer\": \"' || answer || '\"}}</final>' AS final_turn FROM tasks WHERE NOT contains(problem, '<final>')")
def _(spark, d):
    t = tasks(spark, d).where(~F.contains("problem", F.lit("<final>")))
    return t.select("task_id", "row_id", F.array(*[F.lit(x) for x in ("system", "user", "assistant")]).alias("roles"), F.concat(F.lit('<final>{"answer": "'), F.col("answer"), F.lit('"}</final>')).alias("final_turn"))


