"""Numbers of words where polynomial hashes fail: Thue-Morse strings collide modulo 2**64 for every base."""

import random
import zlib

import numpy as np
import pyarrow as pa

from lodecraft.llm import neardup, packing, quality, shards, tokens, words


def thue_morse(a, b, steps=11):
    x = [0]
    for _ in range(steps):
        x += [1 - k for k in x]
    return "".join((a, b)[k] for k in x), "".join((b, a)[k] for k in x)


ONE, OTHER = thue_morse("a", "b")
#: Also as words of one letter, and as runs of pre-tokens.
TEXTS = [ONE, OTHER, " ".join(ONE), " ".join(OTHER), *thue_morse("ü", "é", 10)]


def test_numbers_are_those_of_the_words():
    rng = random.Random(3)
    pool = ["".join(rng.choice("ab\x00é漢Z9") for _ in range(rng.randint(1, 12))) for _ in range(400)] + ["a", "a\x00", "a\x00\x00", "\x00", ONE, OTHER, "x" * 100_000]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(200)] + pool
    seen = {}
    for lower in (False, True):
        for block in words.blocks(pa.array(texts), 5000):
            for w, h in zip((block.data[a:b].tobytes() for a, b in zip(block.starts, block.ends)), words.word_hashes(block, lower).tolist()):
                assert seen.setdefault((lower, w.lower() if lower else w), h) == h
    assert len(set(v for (lower, _), v in seen.items() if not lower)) == len([k for k in seen if not k[0]])


def test_quality_and_near_duplicates(make_docs):
    text = " ".join([ONE, OTHER] * 2 + [f"w{k}" for k in range(40)])  # no window of eight words occurs twice
    found = quality.measure(make_docs([text])).collect()[0]
    assert (found.n_repeat_words, found.base_failed) == (0, False)
    rows = neardup.near_duplicates(make_docs(TEXTS), neardup.Plan(n=3, per_cent=85)).collect()
    roots = {r.doc_id: r.component_id for r in rows}
    assert roots[0] == 0 and roots[1] == 1 and roots[4] == 4 and roots[5] == 5
    assert roots[2] == roots[3] == 2  # of the letters a and b both hold all runs of three that there are


def test_ids_in_one_task_and_in_several(make_docs, monkeypatch):
    code = tokens.encoder(tokens.default_path())
    want = [code.library.encode(x, add_special_tokens=False).ids for x in TEXTS]
    for kept, looked in ((300_000, 24), (1, 24), (300_000, 2), (40, 0)):
        monkeypatch.setattr(tokens, "KEPT", kept)
        monkeypatch.setattr(tokens, "LOOKED_AT", looked)
        for texts, ids in ((TEXTS, want), (TEXTS[::-1], want[::-1])):
            assert [x.tolist() for x in code.encode(texts)] == ids
    docs = make_docs(TEXTS)
    for parts in (1, 3):
        found = {r.doc_id: (r.ids_crc32, r.doc_tokens) for r in packing.pack_documents(docs.repartition(parts)).collect() if r.start == 0 and r.length == r.doc_tokens}
        assert found and all(v == (zlib.crc32(np.array([*want[i], 1], "<u4").tobytes()), len(want[i]) + 1) for i, v in found.items())


def test_shards_hold_the_librarys_ids(spark, make_docs):
    code = tokens.encoder(tokens.default_path())
    rows = shards.training_order(make_docs(TEXTS), 7)
    assert rows.count() > 0
    n = sum(len(code.library.encode(x, add_special_tokens=False).ids) + 1 for x in TEXTS)
    assert n > 5000
