"""Training-order materialisation: fixed-stride token records, each at a slot given by a keyed permutation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import drop, file_system, materialise, new_path
from .packing import row_order
from .tokens import default_path, encoder
from .words import mix

_U = np.uint64
STRIDE = 2048
END = 1
SLOTS_PER_SHARD = 2048
ROUNDS = 6
#: Tasks that write shards, at most; beyond, a task writes several.
WRITERS = 100_000
#: Runs of input rows (about one for each input split) whose first token numbers may be broadcast: at most 32 MB.
BROADCAST_RUNS = 1_000_000


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed bijection of 0..n-1: a balanced Feistel network on the next even number of bits, walked until it lands under n.

    The network's domain is under 4n, so a walk takes fewer than four steps on average.
    """
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = _U((1 << half) - 1), _U(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(key % (1 << 64)))

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return (left << shift) | right

    out = network(index.astype(_U))
    while (over := np.flatnonzero(out >= _U(n))).size:
        out[over] = network(out[over])
    return out.astype(np.int64)


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(run, file, at, before, doc_id, n_tokens, ids): each row's token ids with an end id, in one narrow pass.

    ``file`` and ``at`` say where the row stands. Rows that follow each other in a file and in a task form a run; ``before``
    counts the run's tokens before the row, so only the sums of runs are needed to number all tokens in the order of files and rows.
    Ids are little-endian unsigned numbers of 16 bits if the vocabulary fits, else of 32.
    """
    path = path or default_path()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        width = "<u2" if code.library.get_vocab_size() <= 1 << 16 else "<u4"
        run, last, before = (TaskContext.get().partitionId() << 32) - 1, None, 0
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                ids = [np.append(x, np.uint32(END)).astype(width) for x in code.encode(part.column(1).to_pylist())]
                runs, befores = [], []
                for file, at, x in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), ids):
                    if (file, at) != last:
                        run, before = run + 1, 0
                    runs.append(run)
                    befores.append(before)
                    before += len(x)
                    last = (file, at + 1)
                sizes = pa.array([len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), part.column(2), part.column(3), pa.array(befores, pa.int64()), part.column(0), sizes, pa.array([x.tobytes() for x in ids], pa.binary())], ["run", "file", "at", "before", "doc_id", "n_tokens", "ids"])

    file, at = row_order(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), file.alias("file"), at.cast("long").alias("at"))
    return rows.mapInArrow(go, "run long, file string, at long, before long, doc_id long, n_tokens long, ids binary")


@dataclass(frozen=True)
class Layout:
    """Where the records of a training order lie: slots 0..total-1, slot s in file s div ``slots_per_shard`` at (s mod ``slots_per_shard``) * ``size``."""

    total: int
    stride: int
    width: int
    slots_per_shard: int
    key: int

    @property
    def size(self) -> int:
        return self.stride * self.width

    @property
    def shards(self) -> int:
        return -(-self.total // self.slots_per_shard)

    def records(self, shard: int) -> int:
        return min(self.slots_per_shard, self.total - shard * self.slots_per_shard)

    @cached_property
    def per_task(self) -> int:
        return max(1, -(-self.shards // WRITERS))


def _numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """The written rows of ``coded`` with ``first``, the number of tokens in all runs before theirs; and the number of all tokens."""
    number = F.regexp_extract("file", r"^(?:.*/part-)?(\d+)(?:[-.][^/]*)?$", 1)
    runs = rows.groupBy("run").agg(F.min("file").alias("file"), F.min("at").alias("at"), F.sum("n_tokens").alias("n"))
    place = Window.orderBy(F.coalesce(number.try_cast("long"), F.lit(-1)), "file", "at").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialise(runs.select("run", "n", F.coalesce(F.sum("n").over(place), F.lit(0)).alias("first")), "runs")  # one row for each input split
    count, tokens = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    firsts = runs.select("run", "first")
    return rows.join(F.broadcast(firsts) if count <= BROADCAST_RUNS else firsts, "run"), tokens


def _pieces(rows: DataFrame, layout: Layout) -> DataFrame:
    """(writer, slot, start, n, doc_id, data): the part of each row that lies in each record, ids compressed."""
    stride, width, per_writer = layout.stride, layout.width, layout.per_task * layout.slots_per_shard

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                number, start, n, doc, data = [], [], [], [], []
                for begin, who, ids in zip((part.column(0).to_numpy() + part.column(1).to_numpy()).tolist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                    at, end = begin, begin + len(ids) // width
                    while at < end:
                        to = min(end, (at // stride + 1) * stride)
                        number.append(at // stride)
                        start.append(at % stride)
                        n.append(to - at)
                        doc.append(who)
                        data.append(press.compress(ids[(at - begin) * width : (to - begin) * width]))
                        at = to
                slot = permute(np.array(number, np.int64), layout.total, layout.key)
                yield pa.RecordBatch.from_arrays([pa.array(slot // per_writer, pa.int32()), pa.array(slot), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(doc, pa.int64()), pa.array(data, pa.binary())], ["writer", "slot", "start", "n", "doc_id", "data"])

    return rows.select("first", "before", "doc_id", "ids").mapInArrow(go, "writer int, slot long, start long, n long, doc_id long, data binary")


def _files(pieces: DataFrame, layout: Layout) -> DataFrame:
    """(shard, value): the whole bytes of each shard, in slot order, what no piece covers filled with the end id."""
    size, width, per, blank = layout.size, layout.width, layout.slots_per_shard, np.array([END], f"<u{layout.width}").tobytes()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        shard, out = None, bytearray()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([bytes(out)], pa.binary())], ["shard", "value"])

        for batch in batches:
            for slot, start, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if slot // per != shard:
                    if shard is not None:
                        yield done()
                    shard = slot // per
                    out = bytearray(blank * (layout.records(shard) * layout.stride))
                at, ids = slot % per * size + start * width, press.decompress(data)
                out[at : at + len(ids)] = ids
        if shard is not None:
            yield done()

    tasks = max(1, -(-layout.shards // layout.per_task))
    dealt = pieces.repartitionById(tasks, F.col("writer")).sortWithinPartitions("slot", "start")
    return dealt.select("slot", "start", "data").mapInArrow(go, "shard long, value binary")


def whole_shards(spark: SparkSession, path: str, layout: Layout) -> list[int]:
    """The shards under ``path`` that have their full length. Listed by the driver, one entry a shard."""
    files, where = file_system(spark, f"{path}/shards/shard=*/part-*")
    found = files.globStatus(where) or []
    sizes = {int(f.getPath().getParent().getName().partition("=")[2]): f.getLen() for f in found}
    return sorted(k for k, n in sizes.items() if k < layout.shards and n == layout.records(k) * layout.size + 1)


def write_shards(docs: DataFrame, path: str, key: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, stride: int = STRIDE, slots_per_shard: int = SLOTS_PER_SHARD) -> Layout:
    """Write the training order of ``docs`` under ``path``: ``shards/shard=K`` with one file of fixed-stride records each, and ``index``.

    All texts' ids, each followed by an end id, are one stream in the order of the input's files and rows, cut every ``stride`` tokens;
    the last record is filled with the end id. The number n of a record goes to slot ``permute(n, total, key)``.
    The stream and the slots depend on the files and the key, not on the cluster or on how the files are split into tasks (input that is not
    files is taken in the order of its partitions). Slot s is at (s mod ``slots_per_shard``) * record bytes in
    the file of shard s div ``slots_per_shard``, so any place in the order is one seek away and the rest follows sequentially. A file is its
    records, without separators, and one line feed at its very end, which Spark's text writer puts there.

    Tokens are written once, so a lost executor repeats tasks over fixed rows; then each piece moves to the task of its shard, once.
    Run again after a failure with the same arguments, shards that are there in full are left alone and only the others are written.
    ``index`` (slot, shard, byte_offset, n_tokens, doc_ids) says whose tokens a record holds.

    Null and empty texts are one end id. Rows with null ids, repeated ids or equal columns are all written. Other columns are ignored.
    A text of any length is cut across records; a task holds the ids of one row and one shard. No rows: no shards, an empty index.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_path()
    width = 2 if encoder(tokenizer).library.get_vocab_size() <= 1 << 16 else 4
    kept = new_path(spark, "coded")
    coded(docs, id_col, text_col, tokenizer).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").parquet(kept)
    rows = spark.read.parquet(kept)
    numbered, tokens = _numbered(rows)
    layout = Layout(-(-tokens // stride), stride, width, slots_per_shard, key)
    pieces = _pieces(numbered, layout)
    there = whole_shards(spark, path, layout)
    todo = pieces
    if there:
        files, where = file_system(spark, f"{path}/shards")
        for f in files.listStatus(where):  # what an interrupted run left behind
            if f.isDirectory() and f.getPath().getName().startswith("shard=") and int(f.getPath().getName().partition("=")[2]) not in set(there):
                files.delete(f.getPath(), True)
        ready = spark.createDataFrame([(k,) for k in there], "shard long")
        todo = pieces.withColumn("shard", F.floor(F.col("slot") / slots_per_shard)).join(F.broadcast(ready), "shard", "left_anti").drop("shard")
    _files(todo, layout).select("shard", F.col("value").cast("string").alias("value")).write.partitionBy("shard").mode("append" if there else "overwrite").text(f"{path}/shards")
    held = numbered.select("doc_id", F.col("n_tokens"), (F.col("first") + F.col("before")).alias("begin"))
    held = held.select("doc_id", "begin", (F.col("begin") + F.col("n_tokens")).alias("end"), F.explode(F.sequence(F.floor(F.col("begin") / stride), F.floor((F.col("begin") + F.col("n_tokens") - 1) / stride))).alias("number"))
    per_record = held.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("begin", "doc_id"))).alias("held"), (F.max(F.least("end", (F.col("number") + 1) * stride)) - F.col("number") * stride).alias("n_tokens"))  # at most stride rows a record

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permute(batch.column(0).to_numpy(), layout.total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // slots_per_shard), pa.array(slot % slots_per_shard * layout.size), batch.column(1), batch.column(2)], ["slot", "shard", "byte_offset", "n_tokens", "doc_ids"])

    index = per_record.select("number", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("held.doc_id").alias("doc_ids"))
    index.mapInArrow(place, "slot long, shard long, byte_offset long, n_tokens long, doc_ids array<long>").write.mode("overwrite").parquet(f"{path}/index")
    drop(spark, rows)
    return layout


def read_records(spark: SparkSession, path: str, layout: Layout, first: int = 0, last: int | None = None) -> DataFrame:
    """(slot, shard, byte_offset, record) of the slots first <= slot < last, from the files' bytes; only their shards are read."""
    last = layout.total if last is None else min(last, layout.total)
    per, size = layout.slots_per_shard, layout.size

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                view = content.as_buffer()
                lo, hi = max(first - shard * per, 0), min(last - shard * per, layout.records(shard))
                for at in range(lo, hi, 512):
                    own = range(at, min(at + 512, hi))
                    slots = pa.array([shard * per + i for i in own], pa.int64())
                    yield pa.RecordBatch.from_arrays([slots, pa.array([shard] * len(own), pa.int64()), pa.array([i * size for i in own], pa.int64()), pa.array([view.slice(i * size, size).to_pybytes() for i in own], pa.binary())], ["slot", "shard", "byte_offset", "record"])

    schema = "slot long, shard long, byte_offset long, record binary"
    if layout.total <= first or last <= first:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(f"{path}/shards").select(F.col("shard").cast("long").alias("shard"), "content")
    return files.where(F.col("shard").between(first // per, (last - 1) // per)).mapInArrow(go, schema)


def training_order(docs: DataFrame, key: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, **options) -> DataFrame:
    """(slot, shard, byte_offset, n_tokens, doc_ids, record_crc32): the shards that ``write_shards`` writes under ``path`` (a new shared folder), read back.

    ``record_crc32`` is that of the bytes in the file. The cases are those of ``write_shards``.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "order")
    layout = write_shards(docs, path, key, id_col, text_col, **options)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), crc], ["slot", "record_crc32"])

    found = read_records(spark, path, layout).select("slot", "record").mapInArrow(digest, "slot long, record_crc32 long")
    return spark.read.parquet(f"{path}/index").join(found, "slot").select("slot", "shard", "byte_offset", "n_tokens", "doc_ids", "record_crc32")
