"""Materialising in batches gives the outcomes of all rows at once; audits against plain counts."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodecraft.operators import corpus, sft


def outcomes(rows):
    """(key, place, ok, batch) in any order."""
    seen, out = set(), {}
    for k, p, ok, b in sorted(rows, key=lambda r: (r[3], r[1])):
        out[b, p] = "rejected" if not ok else "duplicate_task" if k in seen else "accepted"
        seen |= {k} if ok else set()
    return out


@pytest.mark.parametrize("sizes", [(60,), (1, 20, 39), (30, 0, 30)])
def test_any_batching(spark, tmp_path, sizes):
    rng = random.Random(len(sizes))
    rows, n = [], 0
    for b, size in enumerate(sizes):
        for _ in range(size):
            rows.append((rng.choice(["hot", "hot", None, f"k{rng.randrange(12)}"]), f"p{n:03d}", rng.random() < 0.5, b))
            n += 1
    schema = "k string, p string, ok boolean, b int"
    batches = sft.Batches(spark, str(tmp_path / "x"), "k", "p", "ok")
    for b in range(len(sizes)):
        part = spark.createDataFrame([r for r in rows if r[3] == b], schema)
        assert batches.add(part, b) and not batches.add(part, b)
    assert {(r.batch, r.p): r.outcome for r in batches.outcomes().collect()} == outcomes(rows)
    at_once = sft.first_accepted(spark.createDataFrame(rows, schema), "k", F.col("p"), F.col("ok"), F.col("b")).collect()
    assert {(r.b, r.p): r.outcome for r in at_once} == outcomes(rows)


def test_batches_go_on_after_a_cut(spark, tmp_path):
    schema = "k string, p string, ok boolean"
    batches = sft.Batches(spark, str(tmp_path / "x"), "k", "p", "ok")
    batches.add(spark.createDataFrame([("a", "1", True)], schema), 0)
    second = spark.createDataFrame([("a", "2", True), ("b", "3", True)], schema)
    batches.add(second, 1)
    (tmp_path / "x" / "outcomes" / "batch=1" / "_SUCCESS").unlink()  # keys were written, outcomes not in full
    again = sft.Batches(spark, str(tmp_path / "x"), "k", "p", "ok")
    assert again.done() == 1
    with pytest.raises(ValueError, match="comes before"):
        again.add(second, 2)
    assert again.add(second, 1)
    assert Counter(r.outcome for r in again.outcomes().collect()) == {"accepted": 2, "duplicate_task": 1}


def test_audit(spark):
    rows = [("train", "a", "1"), ("train", "a", "1"), ("train", "b", "x"), ("frozen_eval", "b", "2"), ("frozen_eval", "c", None), ("rl_dev", "d", "-7")]
    found = {r.split: r for r in corpus.audit_splits(spark.createDataFrame(rows, "split string, task_id string, reference_value string")).collect()}
    assert {s: tuple(r)[3:] for s, r in found.items()} == {"train": (1, 1, 0, 1), "frozen_eval": (0, 1, 1, 1), "rl_dev": (0, 0, 0, 0)}
    assert found["train"].digest == hashlib.sha256(b"a\na\nb").hexdigest() and found["train"].n == 3
