import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodecraft.llm import mixing, packing, tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


TEXTS = ["Hello world", None, "", "don't we'll 'S  x\n\n y", "<|endoftext|> here", "漢字 ünï 🙂 ² ª", "a " * 5000, "x" * 3000, "tie", "tie", "\u0378 unassigned", "'re're '  "]


def test_ids_equal_the_library(library):
    for text, ids in zip(TEXTS, tokens.encoder(tokens.default_path()).encode(TEXTS)):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("as'tmdrevl  \n\t09.,!éß漢   ²\x1c\x85")), max_size=20), max_size=6))
def test_ids_of_any_text(texts):
    code = tokens.encoder(tokens.default_path())
    assert [x.tolist() for x in code.encode(texts)] == [code.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_token_once_and_sequences_without_gaps(make_docs, library):
    found = packing.pack_documents(make_docs(TEXTS)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in enumerate(TEXTS):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.LENGTH


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "same"), (1, "same"), (1, "same"), (None, None)], "doc_id long, text string")
    found = packing.pack_documents(docs).collect()
    assert len(found) == 4 and len({(r.sequence_id, r.offset) for r in found}) == 4
    assert packing.pack_documents(docs.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_patterns_hold_the_histogram(histogram):
    runs = packing.patterns(histogram, 64)
    used = defaultdict(int)
    for run in runs:
        assert sum(run.lengths) <= 64
        for length in run.lengths:
            used[length] += run.count
    assert dict(used) == histogram
    assert len(runs) <= 3 * len(histogram) + 1


def test_little_padding():
    rng = np.random.default_rng(2)
    histogram = dict(zip(*map(np.ndarray.tolist, np.unique(rng.integers(1, 2049, 20000), return_counts=True))))
    packs = sum(r.count for r in packing.patterns(histogram))
    assert sum(k * v for k, v in histogram.items()) / (packs * 2048) > 0.98


@pytest.mark.parametrize("weights", [{"a": 8, "b": 1}, {"a": 1, "b": 8}])
def test_sequences_follow_the_mixed_order(spark, tmp_path, weights):
    docs = spark.createDataFrame([(i, "ab"[i % 7 == 0], "word " * (1 + i * 37 % 90)) for i in range(300)], "doc_id long, source string, text string")
    order = [r.doc_id for r in mixing.mix(docs, weights, block=4).orderBy("mix_slot", "mix_place").collect()]
    mixing.mix_in_order(docs, weights, block=4, partitions=5).write.parquet(str(tmp_path / "mixed"))
    found = packing.pack_in_order(spark.read.parquet(str(tmp_path / "mixed")), room=128, window=32).collect()
    want = {d: k for k, d in enumerate(order)}
    assert sorted(r.doc_id for r in found) == list(range(300))
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length, want[r.doc_id]))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    first = []
    for _, parts in sorted(by_sequence.items()):
        parts.sort()
        assert [o for o, _, _ in parts] == [sum(n for _, n, _ in parts[:k]) for k in range(len(parts))] and sum(n for _, n, _ in parts) <= 128
        assert len({place // 32 for _, _, place in parts}) == 1
        first.append(min(place for _, _, place in parts))
    assert first == sorted(first)


def test_order_of_rows_that_are_not_in_files(spark):
    docs = spark.createDataFrame([(i, "x " * 100) for i in range(50)], "doc_id long, text string").repartition(3).sortWithinPartitions("doc_id")
    found = packing.pack_in_order(docs, room=128, window=8).collect()
    assert [r.doc_id for r in sorted(found, key=lambda r: r.sequence_id)] == [r.doc_id for r in docs.collect()]
    assert packing.pack_in_order(docs.limit(0)).collect() == []
