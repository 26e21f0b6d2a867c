"""Results published as a whole: written aside, hashed, described by a manifest, marked complete, then renamed into place."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import file_system
from . import files

MANIFEST, MARKER = "eval_manifest.json", "COMPLETE"


def publish(spark: SparkSession, target: str, tables: Mapping[str, DataFrame], manifest: Mapping, texts: Mapping[str, str] | None = None) -> dict:
    """Write ``tables`` (as folders of JSON lines) and ``texts`` (as files) to ``target`` and return the manifest with their digests.

    ``target`` must not be there. Nothing is to be seen of it until all is written: the marker, which holds the manifest's digest, comes
    last, then one rename. If anything fails the staged folder is deleted.
    """
    if files.exists(spark, target):
        raise FileExistsError(f"{target} is there already")
    staged = f"{target}.staged"
    system, where = file_system(spark, staged)
    if system.exists(where):
        raise FileExistsError(f"{staged} is there: another run writes it, or has left it")
    system.mkdirs(where)
    try:
        digests = {}
        for name, df in tables.items():
            df.write.json(f"{staged}/{name}.jsonl", ignoreNullFields=False)
            digests[f"{name}.jsonl"] = files.folder_digest(spark, f"{staged}/{name}.jsonl")
        for name, text in (texts or {}).items():
            digests[name] = files.write_bytes(spark, f"{staged}/{name}", text.encode())
        whole = {**manifest, "artifact_sha256": digests}
        files.write_bytes(spark, f"{staged}/{MARKER}", (files.write_json(spark, f"{staged}/{MANIFEST}", whole) + "\n").encode())
        files.rename(spark, staged, target)
    except BaseException:
        system.delete(where, True)
        raise
    return whole


def published(spark: SparkSession, target: str) -> dict:
    """The manifest of a complete publication; an error names what is missing or was changed since."""
    if not files.exists(spark, f"{target}/{MARKER}"):
        raise ValueError(f"{target} is not complete")
    content = files.read_bytes(spark, f"{target}/{MANIFEST}")
    if hashlib.sha256(content).hexdigest() != files.read_bytes(spark, f"{target}/{MARKER}").decode().strip():
        raise ValueError(f"the manifest of {target} was changed")
    manifest = files.read_json(spark, f"{target}/{MANIFEST}")
    for name, digest in manifest["artifact_sha256"].items():
        path = f"{target}/{name}"
        found = files.folder_digest(spark, path) if file_system(spark, path)[0].getFileStatus(file_system(spark, path)[1]).isDirectory() else hashlib.sha256(files.read_bytes(spark, path)).hexdigest()
        if found != digest:
            raise ValueError(f"{path} was changed")
    return manifest


def write_split(tasks: DataFrame, folder: str, name: str) -> dict:
    """A split of the task table, and its part of the data manifest: file, count, digest of ids, digest of files."""
    from .tasks import write_tasks

    spark, path = tasks.sparkSession, f"{folder}/{name}.parquet"
    write_tasks(tasks, path)
    written = spark.read.parquet(path)
    return {"name": name, "file": f"{name}.parquet", "count": written.count(), "task_ids_hash": files.ids_digest(written, "task_id"), "file_hash": files.folder_digest(spark, path)}


def report_row(title: Column, correct: Column, total: Column, valid: Column, p50: Column, p95: Column, rate: Column, peak_bytes: Column) -> Column:
    """One arm as a row of the report's table; what is not known is ``n/a``."""
    def shown(pattern: str, value: Column) -> Column:
        return F.when(value.isNull(), "n/a").otherwise(F.format_string(pattern, value.cast("double")))

    cells = [title, F.format_string("%d/%d", correct.cast("long"), total.cast("long")), F.format_string("%.2f%%", 100.0 * valid), F.format_string("%.2f%%", 100.0 * correct / total), shown("%.2f", p50), shown("%.2f", p95), shown("%.2f", rate), shown("%.2f GiB", peak_bytes / float(2**30))]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def report(rows: list[str], tasks: int, prompt: str, delta: float, interval: tuple[float, float], p: float, outcomes: Mapping[str, int]) -> str:
    """The report of a paired evaluation as Markdown."""
    # Headings of the report.
    head = "| Arm | Correct | Valid-answer rate | Verifier accuracy | p50 latency (ms) | p95 latency (ms) | Tokens/s | Peak GPU memory |"
    facts = {"Tasks": tasks, "Prompt version": f"`{prompt}`", "Accuracy delta (SFT − Base)": f"{delta:.4f}", "Paired bootstrap 95% CI": list(interval), "McNemar p-value": f"{p:.6g}"}
    counts = {k.capitalize(): outcomes.get(k, 0) for k in ("improved", "regressed", "unchanged")}
    bullets = lambda d: "\n".join(f"- {k}: {v}" for k, v in d.items())
    return "\n\n".join(["# Paired Base vs SFT Evaluation", bullets(facts), "\n".join([head, "| --- |" + " ---: |" * 7, *rows]), "## Paired outcomes", bullets(counts), f"Digests of all files are in `{MANIFEST}`."]) + "\n"
