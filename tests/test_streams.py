"""Streams that are cut and started again: episodes as keyed state, journals without repeated keys."""

import random
from datetime import datetime, timedelta

import pytest

from lodecraft.operators import traces as T
from lodecraft.streaming import episodes as E
from lodecraft.streaming import traces as S

SCHEMA = "trace_id long, sequence long, kind string, seconds double, ts timestamp"
KINDS = ["model_output", "tool_call", "tool_result", "invalid_action", "final", "termination"]
START = datetime(2024, 1, 1)


def events(n=40):
    rng = random.Random(9)
    rows = []
    for t in range(n):
        for k in range(rng.randint(1, 9)):
            if rng.random() < 0.9:
                rows.append((t, k, rng.choices(KINDS, [4, 4, 4, 2, 1, 0.3])[0], round(rng.random(), 3), START + timedelta(seconds=60 * t + k)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_and_order_gives_the_batch_fold(spark, tmp_path, seed):
    rows = events()
    want = sorted(T.episodes(spark.createDataFrame(rows, SCHEMA), 4, 2, 0.8).collect(), key=lambda r: r.trace_id)
    rng = random.Random(seed)
    shuffled = rng.sample(rows, len(rows))
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
        part = shuffled[lo:hi] + shuffled[max(0, lo - 3) : lo]  # some come twice
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        stream = S.read_events(spark, str(tmp_path / "events"), SCHEMA, 1)
        E.run(E.episodes(stream, 4, 2, 0.8, late="30 days"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    found = E.latest(spark.read.schema(f"{E.EPISODE}, batch long").parquet(str(tmp_path / "out"))).orderBy("trace_id").collect()
    assert [r[:6] for r in found] == [r[:6] for r in want]
    assert {r.trace_id: r.events for r in found} == {t: sum(r[0] == t for r in rows) for t in {r[0] for r in rows}}


def test_silence_cancels_and_clears(spark, tmp_path):
    deliveries = [
        [(1, 0, "tool_call", None, START), (1, 2, "tool_call", None, START + timedelta(seconds=2)), (2, 0, "final", None, START)],
        [(3, 0, "model_output", None, START + timedelta(hours=5))],
        [(3, 1, "final", None, START + timedelta(hours=5, seconds=1))],
    ]
    for part in deliveries:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        stream = S.read_events(spark, str(tmp_path / "events"), SCHEMA, 1)
        E.run(E.episodes(stream, 9, 9, 9.0, late="1 hour", silence_ms=3_600_000), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    found = {r.trace_id: r for r in E.latest(spark.read.schema(f"{E.EPISODE}, batch long").parquet(str(tmp_path / "out"))).collect()}
    assert (found[1].reason, found[1].closed, found[1].tool_calls, found[1].events) == ("cancelled", True, 2, 2)
    assert (found[2].reason, found[2].closed) == ("final", True)
    assert (found[3].reason, found[3].closed) == ("final", False)


def test_journal_takes_a_key_once_and_reads_nothing_back(spark, tmp_path):
    journal, check, schema = str(tmp_path / "journal"), str(tmp_path / "check"), "k long, v string"
    read = []
    for part in range(4):
        spark.createDataFrame([(k, f"{part}") for k in range(10 * part, 10 * part + 25)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        job = S.append_journal(S.read_events(spark, str(tmp_path / "in"), schema, 1), journal, check, ["k"], {"run": 1})
        job.awaitTermination()
        read.append(job.lastProgress["numInputRows"])
    rows = S.read_journal(spark, journal, schema).collect()
    assert sorted(r.k for r in rows) == list(range(55)) and read == [25] * 4
    with pytest.raises(ValueError, match="another manifest"):
        S.append_journal(S.read_events(spark, str(tmp_path / "in"), schema), journal, check, ["k"], {"run": 2})
    (tmp_path / "check").rename(tmp_path / "moved")
    with pytest.raises(ValueError, match="is gone"):
        S.append_journal(S.read_events(spark, str(tmp_path / "in"), schema), journal, check, ["k"], {"run": 1})


def test_no_rows(spark, tmp_path):
    assert S.read_journal(spark, str(tmp_path / "none"), "k long").collect() == []


def test_neighbours_share_a_key_and_close_apart(spark, tmp_path):
    deliveries = [
        [(t, k, "tool_call", None, START + timedelta(minutes=40 * (t // 50))) for t in range(128) for k in (0, 2)],  # three ends in a bundle of 64
        [(1000, 0, "final", None, START + timedelta(hours=1, minutes=30))],
        [(1000, 1, "final", None, START + timedelta(hours=1, minutes=31)), (60, 1, "final", None, START + timedelta(hours=1, minutes=31))],
    ]
    for part in deliveries:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        stream = S.read_events(spark, str(tmp_path / "events"), SCHEMA, 1)
        job = E.run(E.episodes(stream, 9, 9, 9.0, late="0 seconds", silence_ms=3_600_000), str(tmp_path / "out"), str(tmp_path / "check"))
        job.awaitTermination()
        if part is deliveries[0]:
            assert job.recentProgress[0]["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] == 2
    found = {r.trace_id: r for r in E.latest(spark.read.schema(f"{E.EPISODE}, batch long").parquet(str(tmp_path / "out"))).collect()}
    assert len(found) == 129
    assert all(found[t].closed and found[t].reason == "cancelled" and found[t].events == 2 for t in range(50))
    assert (found[60].reason, found[60].events, found[60].tool_calls) == ("final", 3, 1)
    assert not found[127].closed and not found[1000].closed


def test_micro_batches_do_not_grow_with_the_tasks_that_deliver(spark, monkeypatch):
    from lodecraft.plans import registry

    jobs, run = [], E.run
    monkeypatch.setattr(E, "run", lambda *a: jobs.append(run(*a)) or jobs[-1])
    rows = registry.queries()["stream_episodes"](spark, "/root/testdata/sf0.001").count()
    batches = [[p["numInputRows"] for p in job.recentProgress if p["numInputRows"]] for job in jobs]
    assert rows > 0 and [len(b) for b in batches] == [1, 1, 1]
