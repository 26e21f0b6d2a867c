import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodecraft.llm import langid

WORDS = {
    "aa": "kala mino teru sapo rinta ovelu samka purti niel dosta".split(),
    "bb": "zwurk grøst plumb kvatch brimo jült xerab fnord quaz ølke".split(),
    "cc": "привет снова город река дорога окно письмо время лето дом".split(),
}


def symbols(text):
    out = []
    for c in text:
        letter = unicodedata.category(c)[0] in "LM"
        low = c.lower() if len(c.lower()) == 1 else c
        k = 0 if not letter else ord(low) if ord(low) < 0x10000 else 0xD800 + ((ord(low) - 0x10000) >> 10)
        if k or (out and out[-1]):
            out.append(k)
    return out + [0] if out and out[-1] else out


def grams(text):
    s = [0, 0, 0, *symbols(text)]
    return [tuple(s[i - 3 : i + 1]) for i in range(3, len(s))]


class Brute:
    """Interpolated Kneser-Ney in dictionaries, nothing left out."""

    def __init__(self, texts):
        self.counts = [None] * 5
        self.counts[4] = Counter(g for t in texts for g in grams(t))
        for k in (3, 2, 1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d, self.total, self.kinds = {}, {}, {}
        for k in range(1, 5):
            ones, twos = (sum(c == n for c in self.counts[k].values()) for n in (1, 2))
            self.d[k] = min(0.9, max(0.1, ones / (ones + 2 * twos) if ones + twos else 0.5))
            self.total[k], self.kinds[k] = Counter(), Counter()
            for g, c in self.counts[k].items():
                self.total[k][g[:-1]] += c
                self.kinds[k][g[:-1]] += 1

    def p(self, g):
        if not g:
            return 1 / 65536
        k, h = len(g), g[:-1]
        lower = self.p(g[1:])
        if h not in self.total[k]:
            return lower
        share = (self.counts[k][g] - self.d[k]) / self.total[k][h] if g in self.counts[k] else 0.0
        return share + self.d[k] * self.kinds[k][h] / self.total[k][h] * lower

    def entropy(self, text):
        g = grams(text)
        return -sum(math.log(self.p(x)) for x in g) / len(g)


def corpus(n=400):
    rng = random.Random(5)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 40)))
        out.append((i, text.capitalize() + rng.choice([".", "!\n", " 12, ", ""]), lang))
    return out


def part(i):
    return zlib.crc32(str(i).encode()) % 4


@pytest.fixture(scope="module")
def found(spark):
    data = corpus() + [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 -- ́", "bb"), (1003, "漢字 かな " * 30, None), (None, "kala mino", "aa"), (7, "kala mino", None)]
    df = spark.createDataFrame([(i, t, x, 9, 0.5) for i, t, x in data], "doc_id long, text string, lang string, part int, margin double").repartition(6)
    return data, langid.identify(df).collect()


def test_predictions_equal_brute_force(found):
    data, rows = found
    models = {x: Brute([t for i, t, y in data if y == x and i is not None and part(i) != 2 and t]) for x in WORDS}
    by_key = defaultdict(list)
    for r in rows:
        by_key[r.doc_id].append(r)
    assert len(rows) == len(data)
    for i, text, _ in data[:400]:
        want = sorted((m.entropy(text), x) for x, m in models.items())
        r = next(r for r in by_key[i] if abs(r.entropy - want[0][0]) < 1e-9)
        assert r.lang_pred == want[0][1] and abs(r.margin - (want[1][0] - want[0][0])) < 1e-9 and 0 <= r.score <= 1
        assert r.held_out == (part(i) == 2)


def test_accuracy_rejection_and_defined_cases(found):
    data, rows = found
    lang = {i: x for i, _, x in data[:400]}
    held = [r for r in rows if r.held_out and r.doc_id in lang and lang[r.doc_id]]
    assert len(held) > 60 and sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.98 * len(held)
    assert sum(r.rejected for r in held) <= 0.1 * len(held)
    by_id = {r.doc_id: r for r in rows}
    for i in (1000, 1001, 1002):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, False)
    assert by_id[1003].rejected and by_id[1003].lang_pred in WORDS
    assert by_id[None].lang_pred == "aa" and not by_id[None].held_out
    assert len([r for r in rows if r.doc_id == 7]) == 2


def test_model_is_a_distribution_with_grams_left_out(spark):
    texts = [(t, x, 0) for _, t, x in corpus(60)]
    grams_ = langid.count_grams(spark.createDataFrame(texts, "text string, lang string, part int")).selectExpr("lang", "gram", "fit AS n").cache()
    for capacity in (10**6, 200):
        model = langid.build(grams_, capacity)
        assert sum(len(o.grams) for own in model.orders for o in own) <= capacity
        for k in range(len(model.langs)):
            for history in ((0, 0, 0), (0, ord("k"), ord("a")), (5, 6, 7)):
                base = sum(s << 16 * (3 - j) for j, s in enumerate(history))
                p = np.exp(model.log_p(k, np.arange(65536, dtype=np.uint64) + np.uint64(base)))
                assert abs(p.sum() - 1) < 1e-9
    grams_.unpersist()


def test_long_texts_are_taken_whole(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab c1-éЖ𐐀́") for _ in range(n)) for n in (0, 5, 700, 3, 64, 65, 1)] + [None, "zz"]
    want = [Counter(sum(s << 16 * (3 - j) for j, s in enumerate(g)) for g in grams(t or "")) for t in texts]
    for block in (64, 1 << 20):
        monkeypatch.setattr(langid, "BLOCK", block)
        got = [Counter() for _ in texts]
        for keys, rows, sizes, _ in langid.gram_blocks(texts):
            at = 0
            for row, n in zip(rows, sizes):
                got[row].update(keys[at : at + n].tolist())
                at += n
        assert got == want


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    assert langid.identify(spark.createDataFrame([], schema)).collect() == []
    rows = langid.identify(spark.createDataFrame([(1, "some words", None), (2, None, None)], schema)).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    one = next(i for i in range(50) if part(i) == 0)
    rows = langid.identify(spark.createDataFrame([(one, "some words", "en"), (one + 1, "other", None)], schema)).collect()
    assert {r.lang_pred for r in rows} == {"en"} and all(0 < r.score <= 1 for r in rows)


def test_counts_given_out_early(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD", 10)
    texts = [(t, x, p) for _, t, x in corpus(20) for p in (0, 3)]
    got = {(r.lang, r.gram): (r.fit, r.rest) for r in langid.count_grams(spark.createDataFrame(texts, "text string, lang string, part int")).collect()}
    want = Counter((x, sum(s << 16 * (3 - j) for j, s in enumerate(g))) for _, t, x in corpus(20) for g in grams(t))
    assert got == {k: (n, n) for k, n in want.items()}


def test_nothing_is_left_out_beyond_capacity(spark, monkeypatch):
    data = corpus(200) + [(900, "漢字 " * 40, None), (901, None, "aa"), (902, "12", "bb")] + [(903, "zwurk kala хлеб", "aa")] * 2
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    models = {x: Brute([t for i, t, y in data if y == x and part(i) != 2 and t]) for x in WORDS}
    text = {i: t for i, t, _ in data}
    key = lambda r: r.doc_id
    whole = sorted(langid.identify(df).collect(), key=key)
    for capacity in (200, 0):  # by tables, with a head and without
        monkeypatch.setattr(langid, "BLOCK", 64 if capacity else 1 << 20)
        rows = sorted(langid.identify(df, capacity=capacity).collect(), key=key)
        assert [r[:5] for r in rows] == [r[:5] for r in whole]
        for r in rows:
            if r.doc_id not in (901, 902):
                want = sorted((m.entropy(text[r.doc_id]), x) for x, m in models.items())
                assert r.lang_pred == want[0][1] and abs(r.entropy - want[0][0]) < 1e-9 and abs(r.margin - (want[1][0] - want[0][0])) < 1e-9
