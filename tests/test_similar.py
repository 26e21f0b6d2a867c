"""Near-duplicate links and the greedy choice against brute force."""

import random
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodecraft import storage
from lodecraft.functions import text
from lodecraft.operators import corpus, similar


def sequential(nodes, pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    gone = set()
    for key in sorted(nodes):
        if key not in gone:
            group = {key} | (near[key] - gone)
            gone |= group - {min(group, key=lambda k: nodes[k])}
    return gone


@pytest.mark.parametrize("shape", ["path", "star", "random", "clique", "none"])
def test_rounds_give_the_sequential_choice(spark, shape):
    rng = random.Random(shape)
    keys = [f"{rng.getrandbits(64):016x}" for _ in range(60)]
    nodes = {k: (rng.random() < 0.7, f"t{i}") for i, k in enumerate(keys)}
    pairs = {
        "path": list(zip(sorted(keys), sorted(keys)[1:])) if rng else [],
        "star": [(keys[0], k) for k in keys[1:]] + [(keys[5], keys[9])],
        "random": [tuple(rng.sample(keys, 2)) for _ in range(90)],
        "clique": [(a, b) for a in keys[:25] for b in keys[:25] if a < b] + [(keys[30], keys[31])],
        "none": [],
    }[shape]
    if shape == "path":
        pairs = pairs[:14]
    table = spark.createDataFrame([(k, r) for k, r in nodes.items()], "key string, rank struct<train:boolean,task_id:string>")
    links = spark.createDataFrame(pairs + pairs[:3], "a string, b string")
    assert {r.key for r in similar.greedy_removed(links, table).collect()} == sequential(nodes, pairs)


def texts():
    rng = random.Random(4)
    words = [f"word{k}" for k in range(400)]
    out, base = [], [" ".join(rng.choice(words) for _ in range(120)) for _ in range(6)]
    for k, x in enumerate(base):
        for j in range(30 if k == 0 else 3):
            parts = x.split()
            for _ in range(rng.randint(0, 3)):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            out.append(" ".join(parts))
    return out + ["ab", "ab ", "", "abababab", "ababababab"] + [" ".join(rng.choice(words) for _ in range(60)) for _ in range(20)]


def close(texts, threshold=0.9):
    sets = [set(text.shingle_hashes(x).tolist()) for x in texts]
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9}, sets


@pytest.mark.parametrize(("block", "bands", "rows"), [(64, 20, 4), (4, 20, 4), (4, 3, 8)])
def test_links_equal_brute_force_over_bands(spark, monkeypatch, block, bands, rows):
    monkeypatch.setattr(similar, "BLOCK", block)
    data = texts()
    true, sets = close(data)
    family = similar.permutations(bands * rows, 42)
    bits = [similar.minhash(text.shingle_hashes(x), *family).reshape(bands, rows) for x in data]
    met = {(i, j) for i, j in true if (bits[i] == bits[j]).all(axis=1).any()}
    df = spark.createDataFrame(list(enumerate(data)), "id long, canonical string")
    links = Counter(x for pair in met for x in pair)
    got = {r.id: r for r in similar.lsh_links(df, bands, rows).collect()}
    assert {i: r.links for i, r in got.items()} == {i: links[i] for i in range(len(data))}
    assert all(r.class_id == min(j for j in range(len(data)) if sets[j] == sets[i]) for i, r in got.items())
    pairs = {(r.a, r.b) for r in similar.lsh_pairs(df, bands, rows).collect()}
    assert pairs == {(i, j) for i, j in met if sets[i] != sets[j] and got[i].class_id == i and got[j].class_id == j}
    if bands == 20:
        assert len(met) >= 0.999 * len(true) and len(true) > 400


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    b = np.concatenate([a[:3000], rng.integers(0, 1 << 63, 1000).astype(np.uint64)])
    family = similar.permutations(512, 7)
    share = (similar.minhash(a, *family) == similar.minhash(b, *family)).mean()
    assert abs(share - 3000 / 5000) < 0.07


def test_near_dedup_leaves_no_close_pair(spark):
    data = texts()
    rows = [(f"t{i:03d}", f"d{i % 3}", f"{hash(x) & 0xFFFFFFFF:08x}{i}", x, "eval" if i % 11 == 0 else "train") for i, x in enumerate(data) if x]
    df = spark.createDataFrame(rows, "task_id string, dataset string, content_key string, canonical string, intended_use string")
    true, _ = close([r[3] for r in rows])
    nodes = {r[2]: (r[4] == "train", r[0]) for r in rows}
    gone = sequential(nodes, [(rows[i][2], rows[j][2]) for i, j in true])
    assert {r.content_key for r in similar.near_dedup(df).collect()} == set(nodes) - gone
    assert corpus.near_pairs(df.selectExpr("task_id AS id", "canonical")).count() == len(true)


def test_texts_move_only_where_they_may_be_similar(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"word{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(400)]
    data = [" ".join(base[:320] + [rng.choice(words) for _ in range(80)]) for _ in range(40)] + [" ".join(base), " ".join(base[:-1])]
    stored, keep = {}, similar.materialise

    def counted(df, name):
        stored[name] = keep(df, name)
        rows = stored[name].count()
        stored[name] = (stored[name].columns, rows)
        return keep(df, name)

    monkeypatch.setattr(similar, "materialise", counted)
    true, _ = close(data)
    got = {r.id: r.links for r in similar.lsh_links(spark.createDataFrame(list(enumerate(data)), "id long, canonical string")).collect()}
    assert got == dict(enumerate(sum(i in p for p in true) for i in range(len(data)))) and len(true) < 10
    assert stored["taking"][1] > 40 and stored["alike"][1] <= 20 * 2 * len(true)
    assert all("set" not in columns and "signature" not in columns for columns, _ in stored.values())


def test_rounds_of_units_find_the_same_pairs(spark, monkeypatch):
    data, stored, keep = texts(), [], corpus.materialise
    monkeypatch.setattr(corpus, "ROOM", 1)
    monkeypatch.setattr(corpus, "BLOCK", 1)
    monkeypatch.setattr(corpus, "materialise", lambda df, name: stored.append(name) or keep(df, name))
    found = corpus.near_pairs(spark.createDataFrame(list(enumerate(data)), "id long, canonical string")).collect()
    assert sorted((r.a, r.b) for r in found) == sorted(close(data)[0])
    assert stored.count("units") > 1


def test_parts_that_many_sets_have_are_looked_up_last():
    rng, edges = np.random.default_rng(5), corpus._edges(0.9)
    common = rng.integers(0, 1 << 64, 4000, dtype=np.uint64, endpoint=False)
    rarity = np.full(corpus.PLACES, 100, np.uint8)
    rarity[(common & np.uint64(corpus.PLACES - 1)).astype(np.int64)] = 0
    made = [np.unique(np.append(common, rng.integers(0, 1 << 64, 1800, dtype=np.uint64))) for _ in range(2)]
    sent = [[set(corpus.part_digests(x, 0.9, edges, r).tolist()) for x in made] for r in (None, rarity)]
    assert sent[0][0] & sent[0][1] and len(sent[1][0] & sent[1][1]) < len(sent[0][0] & sent[0][1])
    near = np.unique(np.append(made[0][300:], rng.integers(0, 1 << 64, 200, dtype=np.uint64)))
    assert sent[1][0] & set(corpus.part_digests(near, 0.9, edges, rarity).tolist())


def test_shuffle_files_go_when_a_table_is_written(spark):
    root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p.name for d in root for p in Path(d).rglob("shuffle_*")}
    before = files()
    table = storage.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not {f for f in files() - before if f.endswith(".data")} and spark.conf.get(storage.CLEANUP) == "false"
    assert table.count() == 7
