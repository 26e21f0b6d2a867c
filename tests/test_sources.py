"""Configuration, publication, journals and traces at rest."""

import dataclasses
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from lodecraft.sources import config, files, publish, traces
from lodecraft.sources.journal import Journal

SOURCE = {"name": "a", "uri": "file:///a", "revision": "f" * 40, "license": "mit", "intended_use": "train", "citation": "c", "loader": "jsonl", "answer_type": "integer"}


def failure(call, *args, of=ValueError):
    with pytest.raises(of) as caught:
        call(*args)
    return str(caught.value)


def test_registry(spark, tmp_path):
    path = tmp_path / "sources.json"
    path.write_text(json.dumps({"version": "1", "sources": {"a": SOURCE, "b": SOURCE | {"intended_use": "eval", "loader_params": {"path": "x"}}}}))
    found = config.load_registry(spark, str(path))
    assert found.eval_names() == {"b"}
    assert [(r.source, r.loader_params) for r in found.frame(spark).collect()] == [("a", "{}"), ("b", '{"path": "x"}')]
    text = failure(config.source_registry, {"version": "1", "sources": {"a": SOURCE | {"intended_use": "test", "more": 1}, "b": {"name": 3}, "c": SOURCE | {"loader": "none"}}}, of=config.ConfigError)
    assert all(x in text for x in ("more: unknown", "intended_use", "uri: missing", "name: 3", "loader 'none'"))
    assert "cannot read" in failure(config.load_registry, spark, str(tmp_path / "none.yaml"), of=config.ConfigError)
    assert "mapping" in failure(config.source_registry, [], of=config.ConfigError)


@dataclasses.dataclass(frozen=True)
class Settings:
    rate: float
    steps: int = 3
    name: str = "x"

    def __post_init__(self):
        if self.steps < 1:
            raise ValueError("steps must be positive")


def test_overrides():
    base = config.build(Settings, {"rate": 1}, "s")
    assert config.override(base, ["steps=5", "name=plain text"]) == (Settings(1, 5, "plain text"), {"steps": 5, "name": "plain text"})
    assert config.override(base, []) == (base, {})
    for bad in ("steps", "steps=", "other=1", "steps=1.5", "steps=true", "steps=0"):
        failure(config.override, base, [bad], of=config.ConfigError)


def test_pinned_digest(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text("{}")
    config.require_digest(spark, str(path), hashlib.sha256(b"{}").hexdigest())
    for pinned, said in (("0" * 64, "place-holder"), ("1" * 64, "has digest"), ("G" * 64, "not a SHA")):
        assert said in failure(config.require_digest, spark, str(path), pinned, of=config.ConfigError)
    assert "cannot read" in failure(config.require_digest, spark, str(tmp_path / "none"), "1" * 64, of=config.ConfigError)


def test_split_is_looked_for_in_order(spark, tmp_path):
    manifest = tmp_path / "manifests" / "v1.json"
    (tmp_path / "manifests" / "deep" / "er").mkdir(parents=True)
    find = lambda root=None: config.resolve_split(spark, str(manifest), "s.parquet", root)
    assert find() is None
    (tmp_path / "manifests/deep/er/s.parquet").touch()
    assert find().endswith("deep/er/s.parquet")
    (tmp_path / "manifests/deep/s.parquet").touch()
    assert find() is None
    for folder in ("manifests", "processed/v1", "root"):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / "s.parquet").touch()
        assert find(str(tmp_path / "root")) == str(tmp_path / folder / "s.parquet")


def test_diagnostics(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"source_hash": "a", "outcome": "kept", "n": 1}\n\n')
    assert [(r.source_hash, r.outcome) for r in config.read_diagnostics(spark, str(good)).collect()] == [("a", "kept")]
    for line in ('{"source_hash": 1, "outcome": "x"}', '{"source_hash": "a"}', "[]", "no json"):
        bad.write_text(line + "\n")
        with pytest.raises(Exception, match="no text in"):
            config.read_diagnostics(spark, str(bad)).collect()


def test_plain_values():
    import numpy as np

    assert files.plain({1: (np.int64(2), np.float64(0.5)), "a": [None, True, {"b": {3}}]}) == {"1": [2, 0.5], "a": [None, True, {"b": "{3}"}]}
    assert files.plain(1.0) == 1.0 and math.isnan(files.plain(np.float32("nan")))


def test_small_files(spark, tmp_path):
    path = str(tmp_path / "a.json")
    for value in ({"b": 1, "a": "ü"}, {}):
        digest = files.write_json(spark, path, value)
        assert files.read_json(spark, path) == value and digest == hashlib.sha256(files.read_bytes(spark, path)).hexdigest()
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["a.json"]
    for name in ("x", "y"):
        (tmp_path / name).mkdir()
        (tmp_path / name / name).touch()
    files.replace_folder(spark, str(tmp_path / "x"), str(tmp_path / "y"))
    assert [p.name for p in (tmp_path / "y").iterdir()] == ["x"] and not (tmp_path / "x").exists()
    failure(files.replace_folder, spark, str(tmp_path / "none"), str(tmp_path / "y"), of=Exception)
    assert [p.name for p in (tmp_path / "y").iterdir()] == ["x"]
    failure(files.empty_folder, spark, str(tmp_path / "y"), of=FileExistsError)
    assert files.exists(spark, files.empty_folder(spark, str(tmp_path / "new")))


def test_ids_digest_depends_on_ids_only(spark):
    ids = spark.range(5000).selectExpr("cast(id as string) as i")
    one = files.ids_digest(ids.repartition(7), "i")
    assert one == files.ids_digest(ids.orderBy(F.desc("i")), "i") != files.ids_digest(ids.where("i <> '17'"), "i")
    assert len(files.ids_digest(ids.limit(0), "i")) == 64


def test_publication(spark, tmp_path):
    target = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    whole = publish.publish(spark, target, {"rows": rows, "none": rows.limit(0)}, {"run": 1}, {"report.md": "# R\n"})
    assert publish.published(spark, target) == whole and set(whole["artifact_sha256"]) == {"rows.jsonl", "none.jsonl", "report.md"}
    assert '"t":null' in (spark.read.text(f"{target}/rows.jsonl").where("value like '%2%'").first().value)
    failure(publish.publish, spark, target, {}, {}, of=FileExistsError)
    files.write_bytes(spark, f"{target}/report.md", b"other")
    assert "was changed" in failure(publish.published, spark, target)
    broken = rows.select(F.raise_error(F.lit("no")).alias("x"))
    failure(publish.publish, spark, str(tmp_path / "bad"), {"rows": broken}, {}, of=Exception)
    assert not (tmp_path / "bad").exists() and not (tmp_path / "bad.staged").exists()
    assert "not complete" in failure(publish.published, spark, str(tmp_path / "bad"))


def test_report(spark):
    row = spark.sql("select 'Base' a, 3 c, 4 n, 0.75D v, 12.5D p, cast(null as double) q, 7D r, cast(null as long) g")
    line = row.select(publish.report_row(*[F.col(c) for c in "a c n v p q r g".split()]).alias("l")).first().l
    assert line == "| Base | 3/4 | 75.00% | 75.00% | 12.50 | n/a | 7.00 | n/a |"
    text = publish.report([line], 4, "v1", 0.25, (0.0, 0.5), 0.5, {"improved": 1})
    assert line in text and "- Improved: 1\n- Regressed: 0\n" in text and "0.2500" in text


def test_split_with_digests(spark, tmp_path):
    from lodecraft.sources.tasks import COLUMNS

    tasks = spark.range(30).select(*[F.col("id").cast("string").alias(c) for c in COLUMNS])
    part = publish.write_split(tasks, str(tmp_path), "train")
    assert part["count"] == 30 and part["task_ids_hash"] == files.ids_digest(tasks, "task_id") and len(part["file_hash"]) == 64


def test_journal(spark, tmp_path):
    schema, path = "arm string, task_id string, ok boolean", str(tmp_path / "j")
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    journal = Journal(spark, path, {"seed": 1}, schema)
    assert journal.progress() == {"base": 0, "sft": 0}
    assert journal.append(rows(("base", "a", True), ("sft", "a", False)), 0) and not journal.append(rows(("base", "z", True)), 0)
    again = Journal(spark, path, {"seed": 1}, schema)
    for bad in [("base", "a", True)], [("base", "b", True), ("base", "b", False)], [("base", "", True)], [("base", None, True)], [("other", "a", True)], [(None, "a", True)]:
        failure(again.append, rows(*bad, ("sft", "new", True)), 1)
    assert again.append(rows(("base", "b", True)), 1) and again.append(rows(), 2)
    assert again.progress() == {"base": 2, "sft": 1}
    assert [tuple(r) for r in again.pending(rows(("sft", "a", None), ("sft", "b", None)).select("arm", "task_id")).collect()] == [("sft", "b")]
    assert "another manifest" in failure(Journal, spark, path, {"seed": 2}, schema)
    failure(Journal, spark, str(tmp_path), {}, schema)


def _trajectory(**changes):
    events = [
        {"sequence": 0, "kind": "model_output", "monotonic_ms": 1, "payload": {"generated_tokens": 5}},
        {"sequence": 1, "kind": "tool_call", "monotonic_ms": 1, "payload": {}},
        {"sequence": 2, "kind": "tool_result", "monotonic_ms": 3, "payload": {"name": "python", "result": {"metadata": {"execution_time": 0.5}}}},
        {"sequence": 3, "kind": "final", "monotonic_ms": 4, "payload": {"answer": "42"}},
    ]
    usage = {"steps": 2, "tool_calls": 1, "invalid_actions": 0, "generated_tokens": 5, "python_seconds": 0.5}
    return {"trace_id": "t", "task_id": "k", "events": events, "final_answer": "42", "termination_reason": "final", "usage": usage, "runtime_version": "1"} | changes


def _envelope(t, digest=None):
    text = json.dumps(t, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return json.dumps({"content_hash": digest or hashlib.sha256(text.encode()).hexdigest(), "trajectory": t})


def test_traces(spark, tmp_path):
    def event(i, **changes):
        events = _trajectory()["events"]
        events[i] = events[i] | changes
        return events

    cases = {
        "ok": _envelope(_trajectory(trace_id="ok")), "hash": _envelope(_trajectory(trace_id="hash"), "0" * 64), "bare": json.dumps(_trajectory(trace_id="bare")),
        "sequence": _envelope(_trajectory(trace_id="sequence", events=event(1, sequence=7))), "time": _envelope(_trajectory(trace_id="time", events=event(3, monotonic_ms=2))),
        "tokens": _envelope(_trajectory(trace_id="tokens", events=event(0, payload={"generated_tokens": -1}))), "answer": _envelope(_trajectory(trace_id="answer", events=event(3, payload={"answer": ""}))),
        "seconds": _envelope(_trajectory(trace_id="seconds", events=event(2, payload={"name": "python", "result": {"metadata": {"execution_time": -1}}}))),
        "usage": _envelope(_trajectory(trace_id="usage", usage={"steps": 9})), "final_answer": _envelope(_trajectory(trace_id="final_answer", final_answer="41")),
        "empty": _envelope(_trajectory(trace_id="empty", events=[], usage={}, termination_reason="cancelled", final_answer=None)),
    }
    (tmp_path / "t.jsonl").write_text("\n\n".join([*cases.values(), "no json", "[1]"]) + "\n")
    found = traces.read_traces(spark, str(tmp_path / "t.jsonl"))
    verdicts = {r.trace_id: r.verdict for r in traces.replay(found).collect()}
    assert verdicts == {k: {"bare": "hash", "empty": "ok"}.get(k, k) for k in cases} | {None: "unreadable"}
    loose = {r.trace_id: r.verdict for r in traces.replay(found, check_hash=False).collect()}
    assert loose["bare"] == loose["hash"] == "ok"


def test_digest_keeps_numbers_and_sorts_keys(spark):
    df = spark.createDataFrame([('{"b": 1.0, "a": {"d": "ü", "c": [1, null]}}',), ("x",), (None,)], "j string")
    want = hashlib.sha256('{"a":{"c":[1,null],"d":"ü"},"b":1.0}'.encode()).hexdigest()
    assert [r[0] for r in df.select(traces.content_hash(F.col("j"))).collect()] == [want, None, None]
