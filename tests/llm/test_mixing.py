import heapq
import random
from collections import Counter

import pytest

from lodecraft.llm import mixing


def order(df):
    return sorted(df.collect(), key=lambda r: (r.mix_slot, r.mix_place))


def test_less_than_one_block_from_the_target(make_docs):
    weights = {"a": 5, "b": 2, "c": 1}
    docs = make_docs(["t"] * 1200, ["a"] * 6 + ["b"] * 2 + ["c"])
    rows = mixing.mix(docs, weights, block=10).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1200))
    sizes = Counter(r.source for r in rows)
    slots = {}
    for r in rows:
        assert slots.setdefault(r.mix_slot, r.source) == r.source
    had = Counter()
    done = set()
    for t in range(max(slots) + 1):
        if t in slots:
            had[slots[t]] += 1
        for s, w in weights.items():
            if had[s] * 10 >= sizes[s]:
                done.add(s)
            if s not in done:
                assert abs(had[s] - (t + 1) * w / 8) < 1


def test_order_of_files_and_columns(make_docs):
    docs = make_docs(["t"] * 300, ["a", "b", "b"])
    placed = {r.doc_id: (r.mix_slot, r.mix_place) for r in mixing.mix(docs, {"a": 3}, block=7).collect()}
    out = mixing.mix_in_order(docs, {"a": 3}, block=7, partitions=5)
    assert out.columns == docs.columns
    found = [r.doc_id for r in out.collect()]
    assert found == sorted(placed, key=placed.get) and set(r.mix_slot for r in out.collect()) == {2}


def test_schedule_places_each_turn_in_its_window(spark):
    counts = spark.createDataFrame([("a", 7), ("b", 3), ("c", 2), (None, 1)], "source string, weight long")
    rows = mixing.schedule(counts).collect()
    assert sorted(r.slot for r in rows) == list(range(13))
    for r in rows:
        assert r.turn * 13 // r.weight <= r.slot < -(-(r.turn + 1) * 13 // r.weight)


def edf(weights):
    """The deadline of the turn in each slot, by a heap: whatever the ties, earliest deadline first gives the same deadlines."""
    period, turn, open_, out = sum(weights), [0] * len(weights), [], []
    waiting = [(0, k) for k in range(len(weights))]
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, k = heapq.heappop(waiting)
            heapq.heappush(open_, (-(-(turn[k] + 1) * period // weights[k]), k))
        due, k = heapq.heappop(open_)
        out.append(due)
        turn[k] += 1
        if turn[k] < weights[k]:
            heapq.heappush(waiting, (turn[k] * period // weights[k], k))
    return out


@pytest.mark.parametrize("weights", [[1], [7, 3, 2, 1], [2] * 40 + [8, 5, 3], [random.Random(1).randint(1, 40) for _ in range(200)], [2] * 10_000 + [8, 5, 3]])
def test_schedule_is_earliest_deadline_first(spark, weights):
    rows = mixing.schedule(spark.createDataFrame([(f"s{k}", w) for k, w in enumerate(weights)], "source string, weight long")).collect()
    period, had = sum(weights), Counter()
    by_slot = {r.slot: r for r in rows}
    assert len(rows) == len(by_slot) == period and all(r.period == period for r in rows)
    for slot, due in enumerate(edf(weights)):
        r = by_slot[slot]
        assert r.turn == had[r.source] and r.turn * period // r.weight <= slot < due == -(-(r.turn + 1) * period // r.weight)
        had[r.source] += 1


def test_many_sources(spark):
    docs = spark.range(70_000).selectExpr("id AS doc_id", "concat('s', id % 35000) AS source")
    r = mixing.mix(docs, {"s1": 5}, default=2, block=1).selectExpr("mix_slot").distinct().count()
    assert r == 70_000


def test_very_long_texts_maps_and_own_names(spark):
    docs = spark.sql("SELECT id AS doc_id, 'a' AS source, repeat('long ', 200000) AS text, map('k', id) AS m, 5 AS mix_slot, 6 AS i, 7 AS weight FROM range(3)")
    out = mixing.mix_in_order(docs, {"a": 2})
    assert out.columns == docs.columns and sorted((r.doc_id, len(r.text), r.m["k"], r.mix_slot) for r in out.collect()) == [(k, 1_000_000, k, 5) for k in range(3)]


def test_nulls_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(None, None), (None, None), (1, "a"), (1, "a"), (2, "a")], "doc_id long, source string")
    rows = mixing.mix(docs, {"a": 2}, block=1).collect()
    assert len(rows) == 5 and len({(r.mix_slot, r.mix_place) for r in rows}) == 5
    assert mixing.mix(docs.limit(0), {"a": 2}).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0})
