import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodecraft.llm import resample

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").encode().translate(LOW))


def features(text):
    w = words(text)
    return w + [a + b" " + b for a, b in zip(w, w[1:])]


def brute(docs, target, buckets=10_000, per_cent=25, least=20):
    s, t = Counter(), Counter()
    for rows, into in (([x for _, x in docs], s), (target, t)):
        for text in rows:
            into.update(zlib.crc32(f) % buckets for f in features(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f) // len(f) if f else 0
        h = None if i is None else int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(words(text)) >= least and i is not None])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: len(able) * per_cent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def corpus():
    rng = random.Random(8)
    vocabulary = ["The", "of", "größe", "naïve", "漢字", "x86", "it's", "a-b", "UPPER", "ÀÉ"] + [f"w{k}" for k in range(150)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 19, 20, 21, 60, 200]))) + rng.choice(["", ".", "\n", "\x00"])) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "..."), (203, docs[0][1]), (5, docs[6][1]), (5, docs[6][1]), (None, docs[7][1]), (204, "same " * 500), (205, "long " + " ".join(f"q{k}" for k in range(3000)))]
    return docs, [" ".join(rng.choice(vocabulary[:40]) for _ in range(50)) for _ in range(12)] + [None, ""]


@pytest.mark.parametrize("block, buckets", [(16 << 20, 10_000), (700, 50), (2000, 70_000)])
def test_equals_brute_force(spark, monkeypatch, block, buckets):
    monkeypatch.setattr(resample, "BLOCK", block)
    docs, target = corpus()
    df = spark.createDataFrame([(i, x, 3, "b") for i, x in docs], "doc_id long, text string, weight int, block string").repartition(3)
    aims = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    found = resample.resample(df, aims, buckets=buckets).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(docs, target, buckets)


def test_words_equal_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aZ09 _-é漢\n\x7f~[`{") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None]
    found, sizes = resample.words_of(pa.array(texts, pa.string()).slice(3))
    assert found.to_pylist() == [w for x in texts[3:] for w in words(x)]
    assert sizes.tolist() == [len(words(x)) for x in texts[3:]]


def test_features_of_a_block():
    found, own = resample.block_features(np.array([3, 0, 2]), pa.array([b"b", b"a"], pa.large_binary()), np.array([0, 1, 0, 1, 1]), 7)
    spelled = [own[int(a)].as_py() + (b" " + own[int(b)].as_py() if b >= 0 else b"") for a, b in zip(found.first, found.second)]
    assert dict(zip(spelled, found.counts.tolist())) == {b"a": 3, b"b": 2, b"b a": 1, b"a b": 1, b"a a": 1}
    assert (np.diff(found.part) >= 0).all()
    assert Counter((int(t), spelled[k]) for t, k in zip(found.text, found.feature)) == Counter([(0, b"b"), (0, b"a"), (0, b"b"), (0, b"b a"), (0, b"a b"), (2, b"a"), (2, b"a"), (2, b"a a")])


def test_no_rows_and_no_target(spark):
    schema = "doc_id long, text string"
    empty = spark.createDataFrame([], schema)
    some = spark.createDataFrame([(1, "a b c " * 10), (2, "d e f " * 10), (3, None)], schema)
    assert resample.resample(empty, some).collect() == []
    found = resample.resample(some, empty, per_cent=50).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute([(1, "a b c " * 10), (2, "d e f " * 10), (3, None)], [], per_cent=50)
