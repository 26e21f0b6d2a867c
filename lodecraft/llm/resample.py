"""Importance resampling towards a target: n-gram strings are counted globally, each distinct one is hashed once, and bucket gains go back to the documents."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..storage import drop, materialise, parallelism
from .words import LOWER, as_bytes, mix

_U = np.uint64
#: Bytes of text in a block (a longer text is a block of its own), and bytes of encoded texts, about one or two a word, for each range of the dictionary.
BLOCK, RANGE = 8 << 20, 500_000
# Bytes of words are 0-9, A-Z, a-z and all beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SCHEMA = "block long, target boolean, ids array<long>, sizes binary, vocabulary binary, codes binary"
FOUND = "block long, part int, buckets binary, bucket array<int>, s array<long>, t array<long>"


def _pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.compress(x if isinstance(x, bytes) else x.tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words in lower case, words in each text)."""
    data, offsets = as_bytes(texts)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    inside = IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, stops = inside & edge[:-1], inside & edge[1:]
    starts[1:] |= inside[1:] & ~inside[:-1]
    stops[:-1] |= inside[:-1] & ~inside[1:]
    lengths = np.flatnonzero(stops) + 1 - np.flatnonzero(starts)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(LOWER[data[inside]].tobytes())])
    return words, np.diff(np.searchsorted(np.flatnonzero(starts), offsets))


def _lines(joined: bytes, feeds: bool = True) -> pa.Array:
    """The strings that end with a line feed each, with it or without."""
    data = np.frombuffer(joined, np.uint8)
    ends = np.concatenate([[0], np.flatnonzero(data == 10) + 1]).astype(np.int64)
    if not feeds:
        joined, ends = data[data != 10].tobytes(), ends - np.arange(len(ends))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(joined)])


def _with_feeds(strings: pa.Array) -> tuple[bytes, np.ndarray]:
    """The strings, a line feed after each, end to end; and where each begins."""
    if not len(strings):
        return b"", np.zeros(1, np.int64)
    ended = pc.binary_join_element_wise(strings, pa.scalar(b"", strings.type), pa.scalar(b"\n", strings.type))
    _, offsets, data = ended.buffers()
    places = np.frombuffer(offsets, np.int64)[ended.offset : ended.offset + len(ended) + 1]
    return (b"" if data is None else data.to_pybytes()), places


def encode_blocks(docs: DataFrame, id_col: str, text_col: str, target: bool) -> DataFrame:
    """A row for each block of whole texts: ids, words of each text, the block's distinct words and the text as numbers of words.

    Distinct words stand in the order of their frequency; numbers are kept by byte planes, which compress to about the entropy of the words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, made = 0, 0

        def give() -> pa.RecordBatch:
            coded = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
            raw = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(-np.bincount(raw, minlength=len(coded.dictionary)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            planes = rank[raw].view(np.uint8).reshape(-1, 4).T
            row = [(TaskContext.get().partitionId() << 32) + made, target, pa.concat_arrays([h[1] for h in held]).to_pylist(), _pack(np.concatenate([h[2] for h in held])), _pack(_with_feeds(coded.dictionary.take(pa.array(order)))[0]), _pack(np.ascontiguousarray(planes))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()))], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            _, offsets = as_bytes(batch.column(1))
            at = 0
            while at < len(batch):
                to = int(np.searchsorted(offsets, offsets[at] + BLOCK - size, "right")) - 1
                if to <= at and held:
                    yield give()
                    held, size, made = [], 0, made + 1
                    continue
                to = max(to, at + 1)
                words, sizes = words_of(batch.column(1).slice(at, to - at))
                held.append((words, batch.column(0).slice(at, to - at), sizes))
                size, at = size + int(offsets[to] - offsets[at]), to
        if held:
            yield give()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


class Features(NamedTuple):
    """Distinct features of a block, by dictionary range, then words: numbers of their words (second -1: none), counts; and each occurrence's text and feature."""

    part: np.ndarray
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray
    text: np.ndarray
    feature: np.ndarray


def block_features(sizes: np.ndarray, vocabulary: pa.Array, codes: np.ndarray, parts: int) -> tuple[Features, pa.Array]:
    """The runs of one and two words of a block's texts, and its words in the order that the features refer to."""
    order = pc.sort_indices(vocabulary).to_numpy().astype(np.int64)
    words, v = vocabulary.take(pa.array(order)), len(order)
    rank = np.empty(v, np.int64)
    rank[order] = np.arange(v)
    code, text = rank[codes], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    same = text[1:] == text[:-1]
    key = np.concatenate([code * (v + 1), (code[:-1] * (v + 1) + code[1:] + 1)[same]])
    text = np.concatenate([text, text[1:][same]])
    feature, own = pd.factorize(key)
    del code, key, same
    feature = feature.astype(np.int32)
    first, second = own // (v + 1), own % (v + 1) - 1
    crc = np.append(np.fromiter((zlib.crc32(x) for x in words.to_pylist()), _U, v), _U(0xFFFFFFFF))
    part = (mix((crc[first] << _U(32)) | crc[second]) % _U(parts)).astype(np.int64)
    order = np.lexsort((own, part))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    counts = np.bincount(feature, minlength=len(own))
    return Features(part[order], first[order], second[order], counts[order], text, place[feature]), words


def _read(row: dict, parts: int) -> tuple[Features, pa.Array, np.ndarray]:
    sizes = _unpack(row["sizes"], np.int64)
    planes = _unpack(row["codes"], np.uint8).reshape(4, -1)
    codes = np.ascontiguousarray(planes.T).view(np.uint32).ravel()
    return *block_features(sizes, _lines(zstandard.decompress(row["vocabulary"]), feeds=False), codes, parts), sizes


def block_strings(blocks: DataFrame, parts: int) -> DataFrame:
    """(part, block, target, features, counts): the distinct feature strings of each block, each once, dealt by ranges of the dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f, words, _ = _read(row, parts)
                spelled = pa.concat_arrays([words, pa.nulls(1, words.type)])
                second = np.where(f.second < 0, len(words), f.second)
                joined = pc.binary_join_element_wise(spelled.take(pa.array(f.first)), spelled.take(pa.array(second)), pa.scalar(b" ", words.type), null_handling="skip")
                data, places = _with_feeds(joined)
                edges = np.flatnonzero(np.diff(f.part, prepend=-1)) if len(f.part) else np.zeros(0, int)
                for a, b in zip(edges, [*edges[1:], len(f.part)]):
                    columns = [[int(f.part[a])], [row["block"]], [row["target"]], [_pack(data[places[a] : places[b]])], [_pack(f.counts[a:b].astype(np.int64))]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], ["part", "block", "target", "features", "counts"])

    return blocks.mapInArrow(run, "part int, block long, target boolean, features binary, counts binary")


def dictionary(strings: DataFrame, buckets: int) -> DataFrame:
    """The global dictionary, range by range: equal strings of all blocks are counted together and hashed once.

    Two kinds of rows: (block, part, buckets) has the bucket of each feature of a block in that range, in the block's order; rows without a block have a range's totals by
    bucket over documents (s) and over the target (t).
    """
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        spelled = [_lines(zstandard.decompress(r["features"])) for r in rows]
        coded = pa.concat_arrays(spelled).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        bucket = np.fromiter((zlib.crc32(x[:-1]) % buckets for x in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        totals = np.zeros((2, buckets), np.int64)
        out, at = [], 0
        for r, own in zip(rows, spelled):
            mine = bucket[code[at : at + len(own)]]
            at += len(own)
            totals[int(r["target"])] += np.bincount(mine, weights=_unpack(r["counts"], np.int64), minlength=buckets).astype(np.int64)
            if not r["target"]:
                out.append((r["block"], r["part"], mine.astype(kind).tobytes(), None, None, None))
        used = np.flatnonzero(totals.any(axis=0))
        out.append((None, rows[0]["part"], None, used.tolist(), *totals[:, used].tolist()))
        types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in FOUND.split(", ")])

    return strings.groupBy("part").applyInArrow(run, FOUND)


def gains(found: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 * ln of a bucket's share in the target over its share in the documents), smoothed by one, for each bucket."""
    rows = found.where("block is null").select(F.explode(F.arrays_zip("bucket", "s", "t")).alias("x")).groupBy("x.bucket").agg(F.sum("x.s").alias("s"), F.sum("x.t").alias("t")).collect()
    s, t = [0] * buckets, [0] * buckets
    for r in rows:
        s[r.bucket], t[r.bucket] = r.s, r.t
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((y + 1.0) * all_s / ((x + 1.0) * all_t))) for x, y in zip(s, t)], np.int64)


def weights(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_col: str, buckets: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of ``docs``; a written table."""
    spark = docs.sparkSession
    blocks = materialise(encode_blocks(docs, id_col, text_col, False), "blocks")
    aims = materialise(encode_blocks(target.select(F.lit(None).cast("long").alias("id"), target_col), "id", target_col, True), "target")
    parts = max(parallelism(spark), -(-(blocks.agg(F.sum(F.octet_length("codes"))).first()[0] or 0) // RANGE))
    found = materialise(dictionary(block_strings(blocks.unionAll(aims), parts), buckets), "dictionary")
    sent = spark.sparkContext.broadcast(gains(found, buckets))
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(block: pa.Table, ranges: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        f, _, sizes = _read(row, parts)
        order = np.argsort(ranges["part"].to_numpy())
        hashed = ranges["buckets"].to_pylist()
        bucket = np.frombuffer(b"".join(hashed[k] for k in order), kind)
        gain = sent.value[bucket]
        total = np.bincount(f.text, weights=gain[f.feature], minlength=len(sizes)).astype(np.int64)
        n = np.bincount(f.text, minlength=len(sizes))
        return pa.table([pa.array(row["ids"], pa.int64()), pa.array(sizes), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    own = found.where("block is not null").select("block", "part", "buckets")
    weighed = blocks.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    out = materialise(weighed, "weights")
    for used in (blocks, aims, found):
        drop(spark, used)
    return out


def resample(docs: DataFrame, target: DataFrame, per_cent: int = 25, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = 10_000, min_words: int = 20, seed: int = 7) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``: a draw without replacement that leans towards the texts of ``target``.

    Words are runs of bytes 0-9, A-Z (lower-cased), a-z and beyond ASCII; features are the runs of one and two of them. ``weight`` is the floored mean of the gains of a
    document's features (0 without features), ``score`` the weight with Gumbel noise from the id. Of the N documents with ``min_words`` words the floor(N * per_cent / 100) of highest score
    are drawn, ties to the smaller id, and ranked from 1; the others have no rank.

    Texts are encoded as numbers of words of their block. Each block sends its distinct feature strings, once each, to the dictionary, dealt by hash into as many
    ranges as the corpus needs; so a frequent string is at most one row of each block. The dictionary counts and hashes each string, its totals by bucket make the gains
    (``buckets`` numbers, broadcast), and the buckets of a block's strings return to the block, where they are joined to the features of each document.

    Defined cases: null and empty texts have no features and weight 0. A null id has no score, is not among the N and is not drawn. Repeated rows are documents of
    their own, with equal scores. A long text is a block by itself. An empty target gives gains by the documents' counts alone. Other columns, whatever their
    names, are ignored. No rows: no rows.
    """
    rows = weights(docs, target, id_col, text_col, target_col, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = rows.withColumn("score", F.col("weight") + noise)
    able = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    drawn = rows.where(able).count() * per_cent // 100
    ranked = number_rows(rows.where(able), -F.col("score"), [F.desc("score"), F.col("doc_id")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
