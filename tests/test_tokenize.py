"""Masks and spans against encoding every prefix."""

import random

import pytest

from lodecraft.operators import tokenize as K

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")
LOOSE = "<|{role}|>\n{content}\n"  # lets a message's last blanks run into what follows


def brute(messages, most, template):
    tokenizer = K._tokenizer(PATH)
    ids, spans, text = [], [], ""
    for role, content in messages:
        text += K.render(role, content, template)
        now = tokenizer.encode(text, add_special_tokens=False).ids
        if now[: len(ids)] != ids:
            return "prefix"
        spans.append((role, len(ids), len(now)))
        ids = now
    if len(ids) > most:
        return "length"
    mask = [int(r == "assistant") for r, a, b in spans for _ in range(b - a)]
    return ids, [i if m else -100 for i, m in zip(ids, mask)], mask, spans


def conversations(n=300):
    rng = random.Random(2)
    pieces = ["Hello", " world", "\n", "  ", " \n", "don't", "漢字", "🙂", "12 + 3", "<|x|>", "\t", "", " a", "é", "'", "ll"]
    roles = ["system", "user", "assistant", "tool"]
    return [[(rng.choice(roles), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(1, 6))] for _ in range(n)]


@pytest.mark.parametrize("template", [K.TEMPLATE, LOOSE])
def test_equal_to_prefix_encoding(spark, template):
    data = conversations()
    rows = [(i, k, r, t, 5) for i, m in enumerate(data) for k, (r, t) in enumerate(m)]
    found = {r.conv_id: r for r in K.tokenize(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, n int"), PATH, 90, template).collect()}
    wants = [brute(m, 90, template) for m in data]
    assert {w for w in wants if isinstance(w, str)} == ({"length"} if template == K.TEMPLATE else {"length", "prefix"}) and sum(not isinstance(w, str) for w in wants) > 50
    for i, want in enumerate(wants):
        r = found[i]
        if isinstance(want, str):
            assert r.error and r.input_ids is None and (r.error == want or "length" in (r.error, want)), (i, want, r.error)
        else:
            assert (r.input_ids, r.labels, r.assistant_mask, [tuple(s) for s in r.spans], r.error) == (*want, None)


def test_a_broken_prefix_is_an_error():
    assert K.encode(PATH, [("user", "a \n"), ("assistant", "b")], 100, LOOSE)[4] == brute([("user", "a \n"), ("assistant", "b")], 100, LOOSE) == "prefix"
    assert K.encode(PATH, [("user", "a"), ("assistant", "b")], 100)[4] is None
    assert K.encode(PATH, [("user", "a b c d e f")], 3)[4] == "length"


def test_defined_cases(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert K.tokenize(spark.createDataFrame([], schema), PATH, 10).collect() == []
    rows = [(None, 0, "user", None), (None, 1, "assistant", "yes"), (1, 0, None, "x"), (2, 0, "user", "y" * 200_000), *[(3, k, "user", "") for k in range(3000)]]
    found = {r.conv_id: r for r in K.tokenize(spark.createDataFrame(rows, schema), PATH, 50).collect()}
    assert found[None].error is None and [s.role for s in found[None].spans] == ["user", "assistant"] and sum(found[None].assistant_mask) > 0
    assert found[1].error is None and found[2].error == found[3].error == "length" and found[2].input_ids is None


@pytest.mark.parametrize("template", [K.TEMPLATE, LOOSE])
def test_only_the_rest_is_encoded_again(monkeypatch, template):
    rng = random.Random(5)
    pieces = ["Hello", " world", "\n", "  ", " \n", "don't", "漢字", "🙂", "<|endoftext|>", "<|endof", "text|>", "\t", " a", "\x1c", "\u3000", "'", "ll"]
    for _ in range(400):
        data = [(rng.choice(["user", "assistant"]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(1, 6))]
        want = brute(data, 10**6, template)
        assert K.encode(PATH, data, 10**6, template)[4 if isinstance(want, str) else slice(0, 4)] == want
    seen, library = [], K._tokenizer(PATH)

    class Counted:
        pre_tokenizer = library.pre_tokenizer
        to_str = staticmethod(library.to_str)

        def encode(self, text, **kw):
            seen.append(len(text))
            return library.encode(text, **kw)

    monkeypatch.setattr(K, "_tokenizer", lambda path: Counted())
    K._byte_level.cache_clear()
    for n in (50, 200):
        K.encode(PATH, [("user", "some words here")] * n, 10**6)
        assert sum(seen) < 2 * seen[0]  # not the prefix of each message
        seen.clear()
