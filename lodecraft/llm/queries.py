"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, langid, licenses, mixing, neardup, packing, quality, resample, secrets, shards, topk, url_rules, whitening

#: Host/path rules of the url query, and the key of the training order.
URL_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
ORDER_KEY = 0x5EED
#: Target weights of the mixing query and stage; other sources have weight 2.
MIX_WEIGHTS, MIX_DEFAULT = {"src0": 8, "src1": 5, "src2": 3}, 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    general = [url_rules.Rule(pattern, action, pattern) for pattern, action in url_rules.DEFAULT_RULES]
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), url_rules.pinned_rules(URL_RULES) + general)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, MIX_WEIGHTS, MIX_DEFAULT)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.measure(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunk_low", "chunk_high", "verdict")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.training_order(_table(spark, sf_dir, "documents"), ORDER_KEY)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), neardup.Plan(n=3, per_cent=85))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_license_scans, op3_url_filters, op4_secret_scans, op5_mixing, op6_quality_rules, op7_packing, op8_token_shards, op9_exact_top_k, op10_minhash_near_dedup, op11_language_id, op12_embedding_whitening, op13_importance_resampling)}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _url_sql() -> str:
    import re

    pinned = ", ".join(f"({_quote(text.partition('/')[0])}, {_quote('/' + text.partition('/')[2])}, {_quote(text)}, {_quote(action)})" for text, action in URL_RULES)
    general = "|".join(r"(?:^|\.)" + re.escape(p.removeprefix("||")).replace(r"\-", "-") for p, _ in url_rules.DEFAULT_RULES)
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest
), lowered AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), fits AS (
  SELECT l.page_id, l.host, l.path, x.rule, x.action, row_number() OVER (PARTITION BY l.page_id ORDER BY length(x.rule) DESC) AS k
  FROM lowered l LEFT JOIN (VALUES {pinned}) x(h, p, rule, action)
    ON (l.host = x.h OR ends_with(l.host, '.' || x.h)) AND starts_with(l.path, x.p)
), judged AS (
  SELECT *, list_max(list_transform(list_filter([{", ".join(_quote(p) for p, _ in url_rules.DEFAULT_RULES)}], lambda x: starts_with(host, substr(x, 3)) OR contains(host, '.' || substr(x, 3))), lambda x: printf('%03d', length(x)) || x)) AS hit FROM fits WHERE k = 1
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN hit IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, substr(hit, 4) AS pattern FROM judged"""


def _license_sql() -> str:
    def canonical(x: str) -> str:
        low = f"translate({x}, '{licenses.UPPER}', '{licenses.LOWER}')"
        out = low
        for pattern, flags in ((licenses.COPYRIGHT_LINE, "g"), (licenses.TITLE, ""), (licenses.MARKER, "g")):
            out = f"regexp_replace({out}, {_quote(pattern)}, '', '{flags}')" if flags else f"regexp_replace({out}, {_quote(pattern)}, '')"
        out = f"' ' || trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g')) || ' '"
        for other, usual in licenses.SPELLINGS:
            out = f"replace({out}, ' {other} ', ' {usual} ')"
        return f"trim({out})"

    known = ", ".join(f"({_quote(name)}, {_quote(text)})" for name, text in licenses.KNOWN)
    ready = ", ".join(f"({_quote(digest)}, {_quote(name)})" for name, digest, _ in licenses.DIGESTS)
    return f"""
WITH known AS (
  SELECT sha256({canonical("text")}) AS digest, min(license) AS license FROM (VALUES {known}) k(license, text) GROUP BY 1
  UNION ALL SELECT digest, license FROM (VALUES {ready}) r(digest, license)
), units AS (
  SELECT doc_id, 0::BIGINT AS unit, text AS part FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS unit, unnest(string_split(text, chr(10))) AS part FROM documents WHERE contains(text, chr(10))
)
SELECT doc_id, unit, license, digest FROM (SELECT doc_id, unit, sha256({canonical("part")}) AS digest FROM units) JOIN known USING (digest)"""


_TOP_K_SQL = """
WITH good AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.row AS query_row, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM good q JOIN good c ON q.row <> c.row WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
) WHERE rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scans": _license_sql(), "op3_url_filters": _url_sql(), "op9_exact_top_k": _TOP_K_SQL}
