"""Queries over the problem corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus
from ..operators.numbering import number_rows
from ..storage import materialise
from .registry import query
from .views import CANON, KEPT, RECORDS, SPLITS, records, table

# licences that a source may have, lower case
LICENSES = ("apache-2.0", "mit", "cc-by-4.0", "cc-by-sa-4.0", "cc0-1.0")


def tasks(spark, d):
    return corpus.route(records(spark, d)).where("route = 'kept'")


def winners(spark, d, carry=()):
    return corpus.exact_dedup(tasks(spark, d), carry)


def splits(spark, d):
    return corpus.assign_splits(materialise(winners(spark, d), "winners"))


@query("exact_dedup", f"WITH {KEPT} SELECT task_id, dataset, content_key, copies FROM winners JOIN (SELECT content_key, count(*) AS copies FROM tasks GROUP BY 1) USING (content_key)")
def _(spark, d):
    return winners(spark, d).select("task_id", "dataset", "content_key", "copies")


@query("canonical_text", f"WITH {CANON} SELECT dataset, row_id, canonical FROM canon")
def _(spark, d):
    return records(spark, d).select("dataset", "row_id", text.canonical_text(F.col("problem")).alias("canonical"))


@query("sha256_text", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sha256_hex(F.col("text")).alias("digest"))


@query("source_hash", f"WITH {CANON} SELECT dataset, row_id, source_hash FROM routed")
def _(spark, d):
    return corpus.route(records(spark, d)).select("dataset", "row_id", "source_hash")


@query("task_id", f"WITH {CANON} SELECT dataset, row_id, task_id FROM routed")
def _(spark, d):
    return corpus.route(records(spark, d)).select("dataset", "row_id", "task_id")


@query("canonicalize_kept", f"WITH {CANON} SELECT task_id, dataset, row_id, source_hash, answer AS reference_value, 'unassigned' AS split, 'canonicalize-v1' AS pipeline_version FROM tasks")
def _(spark, d):
    return tasks(spark, d).select("task_id", "dataset", "row_id", "source_hash", F.col("answer").alias("reference_value"), F.lit("unassigned").alias("split"), F.lit("canonicalize-v1").alias("pipeline_version"))


@query("quarantine_routes", f"WITH {CANON} SELECT dataset AS source, source_hash, route AS reason FROM routed WHERE route <> 'kept'")
def _(spark, d):
    return corpus.route(records(spark, d)).where("route <> 'kept'").select(F.col("dataset").alias("source"), "source_hash", F.col("route").alias("reason"))


@query("source_counts", f"WITH {CANON} SELECT dataset, count(*) AS loaded, count(*) FILTER (route = 'kept') AS kept, count(*) FILTER (route <> 'kept') AS quarantined FROM routed GROUP BY 1")
def _(spark, d):
    return corpus.route(records(spark, d)).groupBy("dataset").agg(F.count(F.lit(1)).alias("loaded"), F.count_if(F.col("route") == "kept").alias("kept"), F.count_if(F.col("route") != "kept").alias("quarantined"))


@query("dedup_counts", f"WITH {KEPT} SELECT (SELECT count(*) FROM tasks) AS tasks, (SELECT count(*) FROM winners) AS kept, (SELECT count(*) FROM tasks) - (SELECT count(*) FROM winners) AS exact_removed")
def _(spark, d):
    counted = winners(spark, d).agg(F.sum("copies").alias("tasks"), F.count(F.lit(1)).alias("kept"))
    return counted.withColumn("exact_removed", F.col("tasks") - F.col("kept"))


@query("assign_splits", f"WITH {SPLITS} SELECT task_id, dataset, split FROM splits")
def _(spark, d):
    return splits(spark, d)


@query("task_ids_digest", f"WITH {SPLITS} SELECT split, count(*) AS n, sha256(string_agg(task_id, chr(10) ORDER BY task_id)) AS digest FROM splits GROUP BY 1")
def _(spark, d):
    return corpus.id_digest(splits(spark, d), "split", "task_id")


@query("manifest_row", f"""WITH {SPLITS} SELECT (SELECT count(*) FROM routed) AS loaded, (SELECT count(*) FROM routed WHERE route <> 'kept') AS quarantined, (SELECT count(*) FROM tasks) - (SELECT count(*) FROM winners) AS exact_removed,
  count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'sft_dev') AS sft_dev, count(*) FILTER (split = 'rl_dev') AS rl_dev, count(*) FILTER (split = 'frozen_eval') AS frozen_eval FROM splits""")
def _(spark, d):
    routed = materialise(corpus.route(records(spark, d)).select("route", "content_key", "task_id", "dataset", "intended_use", "row_id"), "routed")
    kept = materialise(corpus.exact_dedup(routed.where("route = 'kept'")), "winners")
    loaded = routed.agg(F.count(F.lit(1)).alias("loaded"), F.count_if(F.col("route") != "kept").alias("quarantined"))
    removed = kept.agg((F.sum("copies") - F.count(F.lit(1))).alias("exact_removed"))
    sizes = corpus.assign_splits(kept).agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "sft_dev", "rl_dev", "frozen_eval")])
    return loaded.join(removed).join(sizes)  # three rows of aggregates


@query("split_audit", f"""WITH {SPLITS}, pool AS (SELECT task_id FROM splits WHERE split <> 'frozen_eval')
SELECT split, count(*) AS n, count(DISTINCT task_id) AS ids, count(*) FILTER (split = 'frozen_eval' AND task_id IN (SELECT task_id FROM pool)) AS leaked FROM splits GROUP BY 1""")
def _(spark, d):
    s = splits(spark, d)
    pool = s.where("split <> 'frozen_eval'").select(F.col("task_id").alias("p")).distinct()
    marked = s.join(pool, s.task_id == pool.p, "left")
    return marked.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("task_id").alias("ids"), F.count_if((F.col("split") == "frozen_eval") & F.col("p").isNotNull()).alias("leaked"))


@query("leakage_semi", f"WITH {CANON} SELECT dataset, row_id, content_key FROM tasks t WHERE intended_use = 'eval' AND content_key IN (SELECT content_key FROM tasks WHERE intended_use = 'train')")
def _(spark, d):
    t = tasks(spark, d)
    train = t.where("intended_use = 'train'").select("content_key")
    return t.where("intended_use = 'eval'").join(train, "content_key", "left_semi").select("dataset", "row_id", "content_key")


@query("id_intersect", f"WITH {CANON} SELECT content_key FROM tasks WHERE intended_use = 'train' INTERSECT SELECT content_key FROM tasks WHERE intended_use = 'eval'")
def _(spark, d):
    t = tasks(spark, d)
    return t.where("intended_use = 'train'").select("content_key").intersect(t.where("intended_use = 'eval'").select("content_key"))


@query("id_except", f"WITH {CANON} SELECT 'only_eval' AS side, content_key FROM (SELECT content_key FROM tasks WHERE intended_use = 'eval' EXCEPT SELECT content_key FROM tasks WHERE intended_use = 'train') UNION ALL SELECT 'only_train', content_key FROM (SELECT content_key FROM tasks WHERE intended_use = 'train' EXCEPT SELECT content_key FROM tasks WHERE intended_use = 'eval')")
def _(spark, d):
    t = tasks(spark, d)
    train, held = (t.where(F.col("intended_use") == u).select("content_key") for u in ("train", "eval"))
    both = held.subtract(train).select(F.lit("only_eval").alias("side"), "content_key")
    return both.unionByName(train.subtract(held).select(F.lit("only_train").alias("side"), "content_key"))


@query("union_sources", f"WITH {RECORDS} SELECT dataset, intended_use, row_id FROM records")
def _(spark, d):
    return records(spark, d).select("dataset", "intended_use", "row_id")


@query("intended_use", f"WITH {RECORDS} SELECT DISTINCT dataset FROM records WHERE intended_use = 'eval'")
def _(spark, d):
    return records(spark, d).where("intended_use = 'eval'").select("dataset").distinct()


@query("src_dispatch", "SELECT 'documents' AS loader, count(*) AS n, 'local' AS revision FROM documents UNION ALL SELECT 'benchmark', count(*), 'local' FROM benchmark UNION ALL SELECT 'conversations', count(*), 'local' FROM conversations")
def _(spark, d):
    from ..sources.readers import load

    out = None
    for name in ("documents", "benchmark", "conversations"):
        rows, revision = load(spark, "parquet", {"path": f"{d}/{name}.parquet"})
        one = rows.agg(F.lit(name).alias("loader"), F.count(F.lit(1)).alias("n"), F.lit(revision).alias("revision"))
        out = one if out is None else out.unionByName(one)
    return out


@query("scan_tasks", f"WITH {SPLITS} SELECT task_id, dataset, split FROM splits WHERE split = 'frozen_eval'")
def _(spark, d):
    return splits(spark, d).where("split = 'frozen_eval'")


@query("metadata_project", "SELECT doc_id, to_json(struct_pack(language := lang, chars := n_chars)) AS metadata FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").withColumn("tags", F.array("lang"))
    return docs.select("doc_id", corpus.metadata(docs, {"lang": "language", "n_chars": "chars", "tags": "tags", "absent": "gone"}).alias("metadata"))


@query("task_flatten", f"WITH {CANON} SELECT task_id, problem, 'integer' AS answer_type, dataset, 'unassigned' AS split, source_hash, 'canonicalize-v1' AS pipeline_version, '{{}}' AS metadata, answer AS reference_value, CAST([] AS VARCHAR[]) AS reference_acceptable_forms FROM tasks")
def _(spark, d):
    from ..sources.tasks import flatten

    return flatten(tasks(spark, d))


@query("row_unflatten", f"WITH {CANON} SELECT task_id, dataset, answer AS value, len(CASE WHEN row_id % 3 = 0 THEN [] WHEN row_id % 3 = 1 THEN ['f'] ELSE ['f', 'g'] END)::BIGINT AS forms FROM tasks")
def _(spark, d):
    from ..sources.tasks import acceptable_forms

    raw = F.when(F.col("row_id") % 3 == 0, F.lit(None)).when(F.col("row_id") % 3 == 1, F.lit('"f"')).otherwise(F.lit('["f", "g"]'))
    return tasks(spark, d).select("task_id", "dataset", F.col("answer").alias("value"), F.size(acceptable_forms(raw)).cast("long").alias("forms"))


@query("public_view", f"WITH {CANON} SELECT task_id, problem, dataset, source_hash FROM tasks")
def _(spark, d):
    return tasks(spark, d).drop("answer").select("task_id", "problem", "dataset", "source_hash")


@query("license_audit", f"""WITH {RECORDS}, s AS (SELECT DISTINCT dataset, CASE length(dataset) % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Proprietary' ELSE 'Apache-2.0' END AS license FROM records)
SELECT dataset, license FROM s WHERE lower(license) NOT IN ({", ".join(repr(x) for x in LICENSES)})""")
def _(spark, d):
    license_ = F.when(F.length("dataset") % 3 == 0, "MIT").when(F.length("dataset") % 3 == 1, "Proprietary").otherwise("Apache-2.0")
    return records(spark, d).select("dataset").distinct().withColumn("license", license_).where(~F.lower("license").isin(*LICENSES))


@query("answer_source_precedence", f"""WITH {RECORDS} SELECT dataset, row_id, CASE WHEN answer IS NOT NULL THEN 'answer' ELSE 'missing' END AS answer_source FROM records""")
def _(spark, d):
    return records(spark, d).select("dataset", "row_id", corpus.answer_of(records(spark, d))[1].alias("answer_source"))


@query("sort_task_id", f"WITH {CANON} SELECT task_id, row_id, row_number() OVER (ORDER BY task_id, row_id) AS place FROM tasks")
def _(spark, d):
    t = tasks(spark, d).select("task_id", "row_id")
    head = F.concat(F.split_part("task_id", F.lit(":"), F.lit(1)), F.lit(":"), F.left(F.split_part("task_id", F.lit(":"), F.lit(2)), F.lit(1)))
    return number_rows(t, head, [F.col("task_id"), F.col("row_id")], "place")


@query("ordered_limit", f"WITH {CANON} SELECT task_id, row_id FROM tasks ORDER BY task_id, row_id LIMIT 100")
def _(spark, d):
    return tasks(spark, d).select("task_id", "row_id").orderBy("task_id", "row_id").limit(100)


@query("seeded_sample", f"WITH {CANON} SELECT task_id, row_id FROM tasks ORDER BY md5('42:' || task_id), task_id, row_id LIMIT 64")
def _(spark, d):
    t = tasks(spark, d).select("task_id", "row_id")
    return t.orderBy(F.md5(F.concat(F.lit("42:"), F.col("task_id"))), "task_id", "row_id").limit(64)


@query("freeze_split", f"""WITH {KEPT}, r AS (SELECT task_id, row_number() OVER (ORDER BY md5('9:' || task_id), task_id) AS r, count(*) OVER () AS n FROM winners)
SELECT task_id, CASE WHEN r <= floor(n * 0.9) THEN 'train' ELSE 'validation' END AS part FROM r""")
def _(spark, d):
    w = winners(spark, d).select("task_id").withColumn("m", F.md5(F.concat(F.lit("9:"), F.col("task_id"))))
    total = w.agg(F.count(F.lit(1)).alias("n"))
    ranked = number_rows(w, F.left("m", F.lit(3)), [F.col("m"), F.col("task_id")], "r").join(F.broadcast(total))
    return ranked.select("task_id", F.when(F.col("r") <= F.floor(F.col("n") * 0.9), "train").otherwise("validation").alias("part"))


@query("sample_per_source", f"WITH {RECORDS} SELECT dataset, row_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY row_id) AS k FROM records) WHERE k <= 5")
def _(spark, d):
    least = F.row_number().over(Window.partitionBy("dataset").orderBy("row_id"))  # Spark keeps 5 a group before it shuffles
    return records(spark, d).select("dataset", "row_id").withColumn("k", least).where("k <= 5").drop("k")


@query("export_task_pool", f"WITH {CANON} SELECT to_json(struct_pack(dataset := dataset, reference := answer, task_id := task_id)) AS value FROM tasks ORDER BY task_id, row_id LIMIT 200")
def _(spark, d):
    rows = tasks(spark, d).orderBy("task_id", "row_id").limit(200)
    return rows.select(F.to_json(F.struct("dataset", F.col("answer").alias("reference"), "task_id")).alias("value"))


@query("dup_key_guard", f"WITH {CANON} SELECT task_id, count(*) AS n FROM tasks GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return tasks(spark, d).groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("adapt_last_user_msg", "SELECT conv_id, coalesce(max_by(text, turn) FILTER (role = 'user'), max_by(text, turn)) AS problem FROM conversations GROUP BY 1")
def _(spark, d):
    from ..sources.readers import last_user_message

    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return c.select("conv_id", last_user_message(F.col("m")).alias("problem"))


@query("sha_shape", f"WITH {CANON} SELECT dataset, row_id, regexp_full_match(source_hash, '[0-9a-f]{{64}}') AS is_sha256, regexp_full_match(left(source_hash, 40), '[0-9a-f]{{40}}') AS is_sha1, regexp_full_match(task_id, '[0-9a-f]{{40}}') AS task_is_sha FROM routed")
def _(spark, d):
    hexa = lambda c, n: c.rlike(f"^[0-9a-f]{{{n}}}$")
    return corpus.route(records(spark, d)).select("dataset", "row_id", hexa(F.col("source_hash"), 64).alias("is_sha256"), hexa(F.left("source_hash", F.lit(40)), 40).alias("is_sha1"), hexa(F.col("task_id"), 40).alias("task_is_sha"))


@query("shingles", f"WITH {CANON} SELECT dataset, row_id, len(list_distinct(list_transform(range(1, greatest(1, length(canonical) - 4) + 1), lambda i: substr(canonical, i, 5))))::BIGINT AS n FROM canon")
def _(spark, d):
    canon = records(spark, d).withColumn("canonical", text.canonical_text(F.col("problem")))
    return canon.select("dataset", "row_id", F.size(text.shingles(F.col("canonical"))).cast("long").alias("n"))


#: Every pair that shares a shingle is counted: no prefix, no order of shingles.
_NEAR = f"""WITH {KEPT}, g AS (SELECT DISTINCT task_id AS id, unnest(list_transform(range(1, greatest(1, length(canonical) - 4) + 1), lambda i: substr(canonical, i, 5))) AS g FROM winners),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1), sized AS (SELECT g.id, g.g, n.n FROM g JOIN n USING (id)),
cnt AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS common FROM sized x JOIN sized y ON x.g = y.g AND x.id < y.id AND least(x.n, y.n) >= greatest(x.n, y.n) * 0.9 GROUP BY ALL)
SELECT a, b, common, na + nb - common AS total FROM cnt WHERE common >= (na + nb - common) * 0.9"""


@query("near_pairs_exact", _NEAR)
def _(spark, d):
    return corpus.near_pairs(winners(spark, d, ["canonical"]).select(F.col("task_id").alias("id"), "canonical"))


def typed_records(spark, d):
    """Records whose answers are of four types, some malformed, some only within a solution: (dataset, row_id, problem, kind, answer, solution)."""
    n, k = F.col("n_chars").cast("string"), F.col("doc_id").cast("string")
    forms = [n, F.concat(n, F.lit("."), k), F.concat(k, F.lit("/"), (F.col("doc_id") % 5).cast("string")), F.concat(F.lit("{"), k, F.lit(", "), n, F.lit("}")), F.concat(F.lit("{"), k, F.lit(",, "), n, F.lit("}")), F.concat(F.lit("["), n, F.lit(", "), k, F.lit(")")), F.concat(F.lit("["), n, F.lit(", "), k), F.lit("  ")]
    kinds = ["integer", "integer", "rational", "set", "set", "interval", "interval", "integer"]
    form = (F.col("doc_id") % 8).cast("int") + 1
    docs = table(spark, d, "documents")
    return docs.select(F.col("source").alias("dataset"), F.col("doc_id").alias("row_id"), F.col("text").alias("problem"), F.element_at(F.array(*[F.lit(x) for x in kinds]), form).alias("kind"), F.element_at(F.array(*forms), form).alias("answer"))


_TYPED = """t AS (SELECT source AS dataset, doc_id AS row_id, text AS problem, ['integer', 'integer', 'rational', 'set', 'set', 'interval', 'interval', 'integer'][doc_id % 8 + 1] AS kind,
  trim(CASE doc_id % 8 WHEN 0 THEN n_chars || '' WHEN 1 THEN n_chars || '.' || doc_id WHEN 2 THEN doc_id || '/' || doc_id % 5 WHEN 3 THEN '{' || doc_id || ', ' || n_chars || '}' WHEN 4 THEN '{' || doc_id || ',, ' || n_chars || '}' WHEN 5 THEN '[' || n_chars || ', ' || doc_id || ')' WHEN 6 THEN '[' || n_chars || ', ' || doc_id ELSE '  ' END) AS answer FROM documents)"""


@query("canonicalize_typed", rf"""WITH {_TYPED} SELECT dataset, row_id, kind, CASE WHEN answer <> '' THEN answer END AS reference_value, CASE WHEN answer = '' THEN 'missing' ELSE 'answer' END AS answer_source,
  CASE WHEN regexp_full_match(problem, '\s*') THEN 'missing_problem' WHEN answer = '' THEN 'missing_answer'
    WHEN CASE kind WHEN 'integer' THEN regexp_full_match(answer, '[+-]?\d+') WHEN 'rational' THEN regexp_full_match(answer, '\d+(/0*[1-9]\d*)?') WHEN 'set' THEN regexp_full_match(answer, '\{{\s*\d+(\s*,\s*\d+)*\s*\}}') ELSE regexp_full_match(answer, '[\[(]\s*\d+\s*,\s*\d+\s*[\])]') END THEN 'kept' ELSE 'unverifiable_reference' END AS route FROM t""")
def _(spark, d):
    return corpus.route(typed_records(spark, d), type_col="kind").select("dataset", "row_id", "kind", "reference_value", "answer_source", "route")


@query("canonicalize_solutions", r"""WITH s AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN text || ' The answer is: ' || conv_id || '.' WHEN 1 THEN 'So oxed{' || turn || '} and oxed{' || conv_id || '}' ELSE text END AS solution FROM conversations),
p AS (SELECT *, regexp_extract_all(solution, '\boxed\{(\d+)\}', 1) AS boxes, regexp_extract_all(solution, '(?i)(?:answer is:|answer:)\s*(\d+)', 1) AS anchors FROM s)
SELECT conv_id, turn, CASE WHEN len(boxes) > 0 THEN boxes[-1] WHEN len(anchors) > 0 THEN anchors[-1] END AS reference_value, CASE WHEN len(boxes) + len(anchors) > 0 THEN 'solution' ELSE 'missing' END AS answer_source, CASE WHEN regexp_full_match(text, '\s*') THEN 'missing_problem' WHEN len(boxes) + len(anchors) > 0 THEN 'kept' ELSE 'missing_answer' END AS route FROM p""")
def _(spark, d):
    c = table(spark, d, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    solution = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" The answer is: "), conv, F.lit("."))).when(F.col("turn") % 3 == 1, F.concat(F.lit("So \\boxed{"), turn, F.lit("} and \\boxed{"), conv, F.lit("}"))).otherwise(F.col("text"))
    rows = c.select(F.lit("talk").alias("dataset"), F.concat_ws("-", conv, turn).alias("row_id"), F.col("text").alias("problem"), solution.alias("solution"), "conv_id", "turn")
    return corpus.route(rows, None, "solution").select("conv_id", "turn", "reference_value", "answer_source", "route")
