"""The queries of operators 11 to 13 over the smallest tables: columns and types, and brute force on real rows."""

import math
import os
import unicodedata
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from lodecraft.llm import queries

from test_resample import brute

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def table(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


def test_language_id(spark):
    df = queries.op11_language_id(spark, FOLDER)
    assert dict(df.dtypes) | {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"} == dict(df.dtypes)
    docs = {r["doc_id"]: r for r in table("documents")}
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    langs = {d["lang"] for i, d in docs.items() if zlib.crc32(str(i).encode()) % 4 != 2}
    for r in rows:
        text = docs[r.doc_id]["text"] or ""
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(unicodedata.category(c)[0] == "L" for c in text)) and r.lang_pred in langs | {"und"}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id]["lang"] for r in held) >= 0.97 * len(held)


def test_whitening(spark):
    df = queries.op12_embedding_whitening(spark, FOLDER)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    vectors = {r["vec_id"]: np.array([math.floor(1024 * x) + 100_000 for x in r["embedding"]], np.int64) for r in table("embeddings")}
    x = np.array(list(vectors.values()))
    n, sums = len(x), x.sum(axis=0)
    mean = sums / n
    values, own = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    rows = df.collect()
    assert len(rows) == 8 * n and {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-9
    w = np.zeros((n, 8))
    place = {v: k for k, v in enumerate(vectors)}
    for r in rows:
        w[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == int(((n * vectors[r.vec_id] - sums) ** 2).sum())
        assert r.explained == pytest.approx(values[-r.component] / values.sum(), rel=1e-9)
    want = (x - mean) @ own[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    assert np.allclose(np.abs(w.T @ want) / n, np.eye(8), atol=1e-7)


def test_resampling(spark):
    df = queries.op13_importance_resampling(spark, FOLDER)
    assert dict(df.dtypes) == {c: "bigint" for c in ("doc_id", "n_features", "weight", "score", "rank")}
    docs = [(r["doc_id"], r["text"]) for r in table("documents")]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == brute(docs, [r["text"] for r in table("benchmark")])
