import math

from pyspark.sql import functions as F

from lodecraft.llm import topk


def brute(rows, k):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (q, v) in enumerate(good):
        if q % 3 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for other, (i, w) in enumerate(good) if other != own)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 20)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rows = [(i, [((i * 37 + j * 11) % 19 - 9) / 16 if (i + j) % 4 else 0.0 for j in range(8)]) for i in range(90)]
    rows += [(91, None), (93, [1.0, None] + [0.0] * 6), (96, [float("nan")] * 8), (99, [float("inf")] * 8), (None, [1.0] * 8), (12, [0.5] * 8), (102, []), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "extra", 1) for i, v in rows], "vec_id long, embedding array<float>, terms string, rank int")
    found = topk.top_k(df, F.col("vec_id") % 3 == 0, k=5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == brute(rows, 5)


def test_fewer_than_k_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    found = topk.top_k(df, F.col("vec_id") == 0, k=20).collect()
    assert sorted((r.rank, r.vec_id) for r in found) == [(1, 1), (2, 2)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).collect() == []
