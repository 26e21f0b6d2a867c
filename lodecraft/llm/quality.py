"""Quality rules: word statistics, and bands of zstandard ratios over whole texts and fixed chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Block, blocks, window_hashes, word_hashes

WINDOW = 8
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, chunk_low double, chunk_high double, base_failed boolean, verdict string, kept boolean"


@dataclass(frozen=True)
class Bands:
    """Limits on compressed bytes / bytes: ``whole`` by text length (up to so many bytes, low, high), and ``chunk`` (low, high).

    Short texts compress badly because the frame and first occurrences weigh more, so their band lies higher. A text is
    repetitive below its band and incompressible above it; so is one of which over ``share`` of the bytes lie in
    chunks of ``chunk_bytes`` outside the chunk band. The last chunk, which may be shorter, has the band of a text of its length.
    """

    whole: tuple[tuple[float, float, float], ...] = ((256, 0.45, 1.10), (1024, 0.35, 0.88), (4096, 0.28, 0.78), (16384, 0.22, 0.70), (float("inf"), 0.18, 0.70))
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.20, 0.75)
    share: float = 0.5
    level: int = 3
    min_words: int = 20
    max_repeat_per_cent: int = 30

    def limits(self, size: int) -> tuple[float, float]:
        return next((low, high) for most, low, high in self.whole if size <= most)


def _covered(words: np.ndarray) -> int:
    """Words that lie in a window of 8 found twice or more."""
    runs = window_hashes(words, WINDOW)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order[1:]] == runs[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def _repeated_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    full = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
    return len(full) - len(set(full))


def _block_rows(block: Block, bands: Bands, squeeze) -> Iterator[tuple]:
    data, words = block.data, word_hashes(block)
    head = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(head)])
    per_word = np.concatenate([[0], np.cumsum(chars[block.ends] - chars[block.starts])])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    view = data.tobytes()
    for i in range(len(block.rows)):
        a, b = int(block.first[i]), int(block.first[i + 1])
        lo, hi = int(block.offsets[i]), int(block.offsets[i + 1])
        text, size, n = view[lo:hi], hi - lo, b - a
        repeat = _covered(words[a:b])
        ratio = squeeze(text) / size if size else 0.0
        low = high = ratio
        outside = 0
        if size >= bands.chunk_bytes:
            parts = [text[at : at + bands.chunk_bytes] for at in range(0, size, bands.chunk_bytes)]
            ratios = [squeeze(x) / len(x) for x in parts]
            low, high = min(ratios), max(ratios)
            for x, r in zip(parts, ratios):
                least, most = bands.chunk if len(x) == bands.chunk_bytes else bands.limits(len(x))
                outside += 0 if least <= r <= most else len(x)
        base_failed = n < bands.min_words or 100 * repeat > bands.max_repeat_per_cent * n
        least, most = bands.limits(size)
        if base_failed:
            verdict = "base"
        elif ratio < least:
            verdict = "repetitive"
        elif ratio > most:
            verdict = "incompressible"
        elif outside > bands.share * size:
            verdict = "chunks"
        else:
            verdict = "keep"
        yield n, int(per_word[b] - per_word[a]), int(symbols[hi] - symbols[lo]), _repeated_lines(text), repeat, ratio, low, high, base_failed, verdict, verdict == "keep"


def measure(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, statistics, ratios, base_failed, verdict, kept) of each row's whole text, without a shuffle.

    Words are runs of characters other than space and TAB..CR. ``n_repeat_words``: words in 8-word windows that are
    in the text twice or more; windows are compared by 64-bit hashes of their words' numbers (``words``). ``ratio``: zstandard bytes over bytes;
    ``chunk_low`` and ``chunk_high``: the least and greatest ratio of a chunk (that of the text, if it is shorter than one).

    Defined cases: null is the empty text: no words, ratio 0, base_failed. Each row is judged alone, so repeated rows get the
    same verdict; ids may be null. Texts are handled about 1 MB at a time, a longer one by itself. Other columns, whatever their names, are
    ignored. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level, write_checksum=False, write_content_size=True)
        names = ["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]]
        types = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[x.split()[1]] for x in SCHEMA.split(", ")]
        for batch in batches:
            for block in blocks(batch.column(1)):
                columns = zip(*_block_rows(block, bands, lambda x: len(press.compress(x))))
                ids = batch.column(0).slice(block.rows.start, len(block.rows))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, types))], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {SCHEMA}")


def reject(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text ``measure`` keeps, with all their columns, in one pass and without a shuffle.

    Null and empty texts are base_failed and go. Null ids and repeated rows are judged like others; columns may have any names and types.
    Texts of any length are judged whole. No rows: no rows.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level, write_checksum=False, write_content_size=True)
        for batch in batches:
            for block in blocks(batch.column(place)):
                keep = pa.array([r[-1] for r in _block_rows(block, bands, lambda x: len(press.compress(x)))], pa.bool_())
                yield batch.slice(block.rows.start, len(block.rows)).filter(keep)

    return docs.mapInArrow(run, docs.schema)
