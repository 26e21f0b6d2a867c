import random
import re
from collections import Counter

import zstandard

from lodecraft.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def texts():
    rng = random.Random(4)
    vocabulary = ["the", "of", "größe", "naïve", "#tag", "$5", "a|b", "x&y", "漢字"] + [f"word{k}" for k in range(300)]
    out = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    line = " ".join(vocabulary[:12])
    return [*out, None, "", " \n\t ", "\n".join([line] * 5), "\n".join([line, line + " ", line]), out[0] + "\n" + out[0], "spam " * 30, "w " * 60000, "\u00a0" * 30]


def test_statistics_equal_brute_force(make_docs):
    data = texts()
    found = {r.doc_id: r for r in quality.measure(make_docs(data)).collect()}
    for i, text in enumerate(data):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), text and text[:60]
        assert not (r.base_failed and r.kept)


def test_bands(make_docs):
    rng = random.Random(6)
    prose = " ".join(rng.choice("the of and to in that is was for with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()) for _ in range(500))
    noise = " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60)) for _ in range(200))
    digits = " ".join(f"{k % 7}" for k in range(4000))
    found = {r.doc_id: r.verdict for r in quality.measure(make_docs([prose, noise, digits])).collect()}
    assert found[0] == "keep" and found[1] == "incompressible" and found[2] in ("base", "repetitive")
    ratio = {r.doc_id: r.ratio for r in quality.measure(make_docs([prose])).collect()}[0]
    raw = prose.encode()
    assert ratio == len(zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True).compress(raw)) / len(raw)


def test_reject_keeps_columns_and_no_rows(spark, make_docs):
    docs = make_docs(texts())
    kept = {r.doc_id for r in quality.measure(docs).where("kept").collect()}
    out = quality.reject(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept
    assert quality.measure(docs.limit(0)).collect() == [] and quality.reject(docs.limit(0)).collect() == []
    twice = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert len(quality.measure(twice).collect()) == 2
