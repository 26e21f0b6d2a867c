"""A training corpus from ``documents``: quality rules, near-duplicates, secrets, mixing, packing.

Each stage gets the rows that the one before kept, and sends them to Python workers in batches of bounded bytes (``prepare``). Quality rules remove documents; of each group of
near-duplicates (five-word shingles, similarity 0.8) one stays; secrets are replaced in the text; mixing puts the documents
in training order, written by ranges of that order; packing numbers sequences along that order and returns their pieces.

Every stage but the last keeps all columns of its input, whatever their names. Null and empty texts, null ids, repeated rows, very long texts and
empty tables are handled as the operator of the stage states: quality rules remove null and empty texts; of rows that repeat an id, near-duplicate
removal keeps one, and rows with a null id all; the later stages keep every row that they get.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodecraft import storage
from lodecraft.llm import mixing, neardup, packing, quality, secrets
from lodecraft.llm.queries import MIX_DEFAULT, MIX_WEIGHTS
from lodecraft.session import prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.reject(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return neardup.keep_one(docs, neardup.Plan(n=5, per_cent=80))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix_in_order(docs, MIX_WEIGHTS, MIX_DEFAULT, partitions=storage.parallelism(spark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_in_order(docs)


STAGES = [("quality_rules", quality_rules), ("minhash_near_dedup", near_dedup), ("secret_scans", secret_scans), ("mix_sources", mix_sources), ("packing", pack_sequences)]

#: zstandard ratios, signatures, a forest and token ids are not SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, applied to ``documents``; each stage's rows are written and read again, and deleted once the next ones are written."""
    docs = source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, storage.materialise(stage(spark, docs, sf_dir), name)
        if before is not source:
            storage.drop(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
