import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodecraft import storage
from lodecraft.llm import neardup, words
from lodecraft.operators.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(texts, n, per_cent):
    sets = {i: shingles(t, n) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= per_cent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed=3, n=140):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "ß", "Word", "naïve"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 120))] for _ in range(12)]
    out = []
    for _ in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 4, 9))):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        out.append(rng.choice((" ", "\n", "  ")).join(text).replace("w1", rng.choice(("w1", "W1"))))
    return [*out, None, "", "   ", "one", "ONE", "one two", "a b c d e f", "x " * 9000, "y " * 9000 + "z"]


@pytest.mark.parametrize(("n", "per_cent"), [(3, 85), (5, 80)])
def test_equals_brute_force(make_docs, n, per_cent):
    texts = corpus()
    found = neardup.near_duplicates(make_docs(texts), neardup.Plan(n=n, per_cent=per_cent)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute(dict(enumerate(texts)), n, per_cent)


@pytest.mark.parametrize(("n", "per_cent"), [(3, 85), (5, 80), (1, 50), (2, 100)])
def test_exact_plans_equal_brute_force(make_docs, n, per_cent):
    texts = corpus(8, 110)
    found = neardup.near_duplicates(make_docs(texts), neardup.Plan(n=n, per_cent=per_cent, exact=True)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute(dict(enumerate(texts)), n, per_cent)


@pytest.mark.parametrize("per_cent", [50, 80, 85, 100])
def test_parities_never_turn_away_a_similar_pair(per_cent):
    rng = np.random.default_rng(per_cent)
    turned = 0
    for _ in range(1500):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: int(rng.integers(0, n + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, n))).astype(np.uint64)])
        if len(b):
            common = len(np.intersect1d(a, b))
            similar = 100 * common >= per_cent * (len(np.union1d(a, b)))
            may = neardup.may_be_close(neardup.parities(np.unique(a)), neardup.parities(np.unique(b)), per_cent)
            assert may or not similar
            turned += not may
    assert turned > 300


def test_large_buckets_are_compared_by_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "SIDE", 900)
    rng = random.Random(5)
    base = [f"t{k}" for k in range(60)]
    texts = []
    for _ in range(120):
        text = list(base)
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(60)] = f"u{rng.randrange(1000)}"
        texts.append(" ".join(text))
    plan = neardup.Plan(n=3, per_cent=85)
    found = neardup.near_duplicates(make_docs(texts), plan).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute(dict(enumerate(texts)), 3, 85)


def test_null_ids_repeated_rows_and_repeated_ids(spark):
    a, b, c = "a b c d e f g", "q r s t u v w", "k l m n o p"
    docs = spark.createDataFrame([(None, a), (None, a), (3, a), (3, a), (5, a), (5, b), (9, b), (8, c), (8, None)], "doc_id long, text string")
    found = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()]
    want = [(None, None, True)] * 2 + [(3, 3, True)] * 2 + [(5, 3, False)] * 2 + [(9, 3, False)] + [(8, 8, True)] * 2
    assert sorted(found, key=str) == sorted(want, key=str)
    kept = [r.doc_id for r in neardup.keep_one(docs).collect()]
    assert sorted(kept, key=str) == [3, 8, None, None]


def test_results_do_not_depend_on_what_is_broadcast(make_docs, monkeypatch):
    docs = make_docs(corpus(5, 60))
    want = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect()), sorted(r.doc_id for r in neardup.keep_one(docs).collect())
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    assert want == (sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect()), sorted(r.doc_id for r in neardup.keep_one(docs).collect()))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).collect() == [] and neardup.keep_one(docs).collect() == []


def test_pigeonhole_guarantee():
    """Any two signatures within the radius share a key."""
    plan = neardup.Plan(n=3, per_cent=85)
    rng = np.random.default_rng(1)
    kept = ~(np.uint64(255) << (np.uint64(8) * np.arange(8, dtype=np.uint64)))
    for _ in range(300):
        x = rng.integers(0, 256, plan.places, dtype=np.uint8)
        y = x.copy()
        at = rng.choice(plan.places, plan.radius, replace=False)
        y[at] ^= rng.integers(1, 256, plan.radius, dtype=np.uint8)
        cx, cy = (np.frombuffer(v.tobytes(), np.uint64)[:, None] & kept for v in (x, y))
        assert (cx == cy).any()


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    found = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 51)}, **{100 + k: 100 for k in range(1, 30)}}


def test_words_match_the_pattern():
    texts = ["a  b", "", None, "\u00a0x y\x1cz", "end", "start\n", "ünï cöde\t\x0b\x0c"]
    found = []
    for block in words.blocks(pa.array(texts), size=8):
        for i in range(len(block.rows)):
            span = range(block.first[i], block.first[i + 1])
            found.append([bytes(block.data[block.starts[k] : block.ends[k]]).decode() for k in span])
    assert found == [WORD.findall(t or "") for t in texts]


def test_hashes_do_not_depend_on_the_pieces_of_a_long_text(monkeypatch):
    texts = pa.array(["alpha beta  gamma " * 40, "", "b" * 300 + " c", None, "É ß alpha"])
    whole = [words.word_hashes(b, True) for b in words.blocks(texts, 1 << 20)]
    monkeypatch.setattr(words, "BLOCK", 50)
    pieces = [words.word_hashes(b, True) for b in words.blocks(texts, 1 << 20)]
    assert len(whole) == 1 and (whole[0] == pieces[0]).all() and whole[0][0] == whole[0][-1]


def test_only_the_kept_ids_stay_in_storage(make_docs, spark):
    docs = make_docs(corpus(n=60))
    files, folder = storage.file_system(spark, storage.own_dir(spark))
    there = {str(f.getPath()) for f in files.listStatus(folder)} if files.exists(folder) else set()
    kept = neardup.keep_one(docs, neardup.Plan(n=5, per_cent=80))
    left = {str(f.getPath()) for f in files.listStatus(folder)} - there
    assert kept.count() > 0
    assert len(left) == 1 and "/kept-" in left.pop()
