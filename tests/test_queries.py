"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from lodecraft.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = [tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall()]
    got = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_near_pairs_of_the_smallest_tables(spark):
    """Near-duplicates leave one of each pair, and what is left has no pair."""
    from lodecraft.operators import corpus, similar
    from lodecraft.plans.corpus import winners

    w = winners(spark, FOLDER, ["canonical"])
    pairs = corpus.near_pairs(w.selectExpr("task_id AS id", "canonical")).collect()
    kept = {r.task_id for r in similar.near_dedup(w).collect()}
    assert pairs and not [p for p in pairs if p.a in kept and p.b in kept]
    assert len(kept) >= w.count() - len(pairs)
