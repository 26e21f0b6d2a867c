"""Packing token pieces into sequences: shortest-pack-first over the length histogram, joined back by rank."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import group_ranks
from ..storage import materialise
from .tokens import default_path, encoder

LENGTH = 2048
END = 1
#: Rows that are packed together where sequences follow the rows' order.
WINDOW = 4096


class Run(NamedTuple):
    """``count`` packs of one pattern: ``lengths`` laid end to end."""

    lengths: tuple[int, ...]
    count: int


def patterns(histogram: dict[int, int], room: int = LENGTH) -> list[Run]:
    """Packs for ``histogram`` (length -> pieces), by shortest-pack-first.

    Lengths are placed longest first, whole groups of equal pieces at a time, each into the packs with most room left;
    when none has room, new packs open. Every step uses up either a group of packs or the length, so there are
    at most two groups for each length: the work and the result grow with the lengths, not with the pieces.
    """
    by_room: dict[int, list[Run]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed: list[tuple[int, Run]] = []
        for space in sorted((r for r in by_room if r >= length), reverse=True):
            while left and by_room[space]:
                run = by_room[space].pop()
                n = min(left, run.count)
                placed.append((space - length, Run((*run.lengths, length), n)))
                if run.count > n:
                    by_room[space].append(Run(run.lengths, run.count - n))
                left -= n
            if not by_room[space]:
                del by_room[space]
            if not left:
                break
        if left:
            per = room // length
            if full := left // per:
                placed.append((room - per * length, Run((length,) * per, full)))
            if rest := left % per:
                placed.append((room - rest * length, Run((length,) * rest, 1)))
        for space, run in placed:
            by_room[space].append(run)
    return sorted((r for runs in by_room.values() for r in runs), reverse=True)


class Place(NamedTuple):
    """Pieces of one length with rank ``lo <= rank < hi`` go to sequence ``first + rank - lo``, at ``offset``."""

    length: int
    lo: int
    hi: int
    first: int
    offset: int


def places(runs: list[Run]) -> list[Place]:
    """Which ranks of each length go where; sequence ids are gapless from 0."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for run in runs:
        at = 0
        for length in run.lengths:
            out.append(Place(length, used[length], used[length] + run.count, sequence, at))
            used[length] += run.count
            at += length
        sequence += run.count
    return out


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, room: int = LENGTH, with_ids: bool = False, order: Sequence[Column] = ()) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of each text's token ids and an end id, cut into pieces of ``room`` and a rest.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit numbers. ``with_ids`` adds those bytes as ``ids``.
    ``order``, a string and a long, is carried along as ``part`` and ``at``.
    """
    path, carried = path or default_path(), [2, 3] if order else []
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids, *["part", "at"][: len(carried)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                rows: list[list] = [[] for _ in range(6)]
                source: list[int] = []
                for k, (doc, ids) in enumerate(zip(part.column(0).to_pylist(), code.encode(part.column(1).to_pylist()))):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    for start in range(0, len(ids), room):
                        piece = ids[start : start + room].tobytes()
                        for column, value in zip(rows, (doc, start, len(piece) // 4, zlib.crc32(piece), len(ids), piece)):
                            column.append(value)
                        source.append(k)
                arrays = [pa.array(c, pa.int64()) for c in rows[:5]] + [pa.array(rows[5], pa.binary())] * with_ids + [part.column(c).take(pa.array(source, pa.int64())) for c in carried]
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[c.alias(n) for c, n in zip(order, ("part", "at"))])
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids + ", part string, at long" * bool(order))


def pack(pieces: DataFrame, room: int = LENGTH) -> DataFrame:
    """``pieces`` (doc_id, start, length, ids_crc32, doc_tokens, ...) with the sequence_id and offset of each.

    ``pieces`` is read twice, so give it written. Only the histogram, at most ``room`` rows, reaches the driver.
    The places that it computes are broadcast: at most two groups of packs for each length, whatever the input.
    They are joined to the pieces by length and by rank within the length; ranks are numbered by salted windows, so
    one length may hold most pieces.
    """
    spark = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}
    if counts and max(counts) > room:
        raise ValueError(f"a piece is longer than {room}")
    table = spark.createDataFrame([tuple(map(int, p)) for p in places(patterns(counts, room))], "p_length long, lo long, hi long, first long, offset long")
    ranked = group_ranks(pieces, ["length"], [F.col(c) for c in ("doc_id", "start", "doc_tokens", "ids_crc32")], "rank")
    on = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    joined = ranked.join(F.broadcast(table), on)
    return joined.withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("lo")).drop("p_length", "lo", "hi", "first", "rank")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, room: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every row of ``docs``.

    A row's tokens are its text's ids and an end id, so null and empty texts are one token. Each token lies in
    exactly one piece; a sequence's pieces fill it from 0 without gaps and hold at most ``room`` tokens. Texts of
    any length are cut at multiples of ``room``; what is left is packed by length.

    Rows that repeat an id, or all columns, are packed once each. A null id is carried along. Other columns are
    ignored. No rows: no rows. Texts are encoded once; the pieces, without their ids, are written to shared storage.
    """
    return pack(materialise(token_pieces(docs, id_col, text_col, path, room), "pieces"), room)


def row_order(docs: DataFrame) -> tuple[Column, Column]:
    """Where a row stands: file and row within it for Parquet files, else partition and row within it."""
    try:
        found = docs.metadataColumn("_metadata")
        order = found["file_path"], found["row_index"]
        docs.select(*order).schema  # noqa: B018
        return order
    except AnalysisException:
        at = F.monotonically_increasing_id()
        return F.shiftright(at, 33).cast("string"), at.bitwiseAND(F.lit((1 << 33) - 1))


def _part_number(part: str) -> tuple[int, str]:
    number = re.fullmatch(r"(?:.*/part-)?(\d+)(?:[-.][^/]*)?", part)
    return int(number[1]) if number else -1, part


def _pack_window(window: pa.Table, room: int) -> pa.Table:
    """Pieces of one window with local sequence numbers, which follow the sequences' first pieces."""
    window = window.sort_by([("position", "ascending"), ("start", "ascending")])
    lengths = window["length"].to_numpy()
    by_length = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for p in places(patterns({n: len(rows) for n, rows in by_length.items()}, room)):
        rows = by_length[p.length][p.lo : p.hi]
        sequence[rows], offset[rows] = p.first + np.arange(len(rows)), p.offset
    first = np.unique(sequence, return_index=True)[1]
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    columns = [window[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "window")]
    return pa.table([*columns, pa.array(number[sequence]), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "own", "offset"])


def pack_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, room: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """What ``pack_documents`` gives, with sequences in the order of the rows of ``docs``.

    The order is that of the Parquet files that ``docs`` reads, by part number and row (``mixing.mix_in_order`` writes them so),
    else of its partitions. Each ``window`` rows are packed for themselves, so the sequences of one window
    hold its pieces and no others, and come before those of the next; within a window sequences are numbered by their first piece.
    Positions come from the files' row counts, of which the driver gets one for each file; a window is packed in one task.
    """
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, id_col, text_col, path, room, order=row_order(docs)), "pieces")
    parts, first = [], 0
    for part, rows in sorted(pieces.where("start = 0").groupBy("part").agg(F.count(F.lit(1))).collect(), key=lambda r: _part_number(r[0])):
        parts.append((part, first))
        first += rows
    table = spark.createDataFrame(parts, "part string, first long")
    position = F.col("first") + F.col("at")
    placed = pieces.join(F.broadcast(table), "part").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", position.alias("position"), F.floor(position / window).cast("long").alias("window"))

    def run(group: pa.Table) -> pa.Table:
        return _pack_window(group, room)

    packed = placed.groupBy("window").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, own long, offset long")
    packed = materialise(packed, "packed")
    sizes = packed.groupBy("window").agg((F.max("own") + 1).alias("n"))
    before = Window.orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("window", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return packed.join(starts, "window").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset", (F.col("first") + F.col("own")).alias("sequence_id"))
