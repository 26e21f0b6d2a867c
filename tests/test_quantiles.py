"""Quantiles, digests and exact p-values against plain Python."""

import hashlib
import math
import random

import pytest

from lodecraft.operators import corpus, evaluation, quantiles


def interpolated(values, q):
    values = sorted(x for x in values if x is not None and not math.isnan(x))
    if not values:
        return None
    place = (len(values) - 1) * q
    low, high = values[math.floor(place)], values[math.ceil(place)]
    return low + (high - low) * (place - math.floor(place))


@pytest.mark.parametrize("parts", [2, 1024])
def test_quantiles(spark, monkeypatch, parts):
    monkeypatch.setattr(quantiles, "PARTS", parts)
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1), 5.0, rng.random() * 10**rng.randint(0, 5)]), rng.choice([None, float("nan"), float(rng.randint(0, 4))])) for _ in range(700)]
    rows += [("one", 3.5, None), ("none", None, None), ("same", 2.0, 1.0), ("same", 2.0, 1.0), ("wide", -1e300, 0.0), ("wide", 1e300, 1.0), ("wide", 0.25, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    wanted = {"p0": ("x", 0.0), "p37": ("x", 0.37), "p50": ("x", 0.5), "p100": ("x", 1.0), "y95": ("y", 0.95)}
    found = {r.g: r for r in quantiles.quantiles(df, ["g"], wanted).collect()}
    assert set(found) == {r[0] for r in rows}
    for g, r in found.items():
        for name, (c, q) in wanted.items():
            want = interpolated([x["xy".index(c) + 1] for x in rows if x[0] == g], q)
            assert r[name] == want or want is not None and math.isclose(r[name], want, rel_tol=1e-12), (g, name)
    assert quantiles.quantiles(df.limit(0), ["g"], wanted).collect() == []


@pytest.mark.parametrize(("b", "c"), [(0, 0), (0, 5), (3, 22), (1, 1), (100, 140), (5000, 5200), (70_000, 69_000)])
def test_mcnemar_of_any_size(spark, b, c):
    from fractions import Fraction

    d, m = b + c, min(b, c)
    term = tail = 1
    for k in range(1, m + 1):
        term = term * (d - k + 1) // k
        tail += term
    want = float(min(Fraction(1), Fraction(2 * tail, 2**d)))
    df = spark.createDataFrame([(b, c)], "b long, c long")
    assert df.select(evaluation.mcnemar(df.b, df.c).alias("p")).first().p == pytest.approx(want, abs=2e-9)


def test_digest_streams_over_batches(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["x", "y", None, "z"]), rng.choice([None, f"{rng.random()}", "é", "漢"])) for _ in range(30_000)]
    found = {r.s: (r.n, r.digest) for r in corpus.id_digest(spark.createDataFrame(rows, "s string, id string"), "s", "id").collect()}
    for s in ("x", "y", None, "z"):
        ids = sorted(i for k, i in rows if k == s and i is not None)
        assert found[s] == (len(ids), hashlib.sha256("\n".join(ids).encode()).hexdigest())
    assert corpus.id_digest(spark.createDataFrame([], "s string, id string"), "s", "id").collect() == []


@pytest.mark.parametrize(("up", "down", "same"), [(30, 10, 60), (0, 0, 5), (7, 0, 0), (0, 9, 1), (400, 380, 1220)])
def test_bootstrap_by_counts_agrees_with_draws(spark, up, down, same):
    rows = [(False, True)] * up + [(True, False)] * down + [(True, True)] * same
    df = spark.createDataFrame(rows, "base boolean, sft boolean")
    one, other = evaluation.bootstrap(df).first(), evaluation.bootstrap_counts(df).first()
    n = up + down + same
    spread = math.sqrt(max((up + down) / n - ((up - down) / n) ** 2, 0) / n)
    assert (one.n, one.delta) == (other.n, other.delta)
    assert abs(one.low - other.low) <= 0.12 * spread + 1.01 / n and abs(one.high - other.high) <= 0.12 * spread + 1.01 / n
    assert evaluation.bootstrap_counts(df.repartition(3)).first() == other
    assert evaluation.bootstrap_counts(df.limit(0)).collect() == []
