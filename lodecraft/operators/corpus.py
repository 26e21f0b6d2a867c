"""The problem corpus: canonical tasks and quarantine, duplicates, splits, audits."""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..functions import answers, text
from ..storage import drop, materialise
from .numbering import number_rows
from .skew import hot_limit, join_counted

# Quarantine reasons, ratios of the splits.
REASONS = ("missing_problem", "missing_answer", "ambiguous_answer", "unverifiable_reference", "parse_error")
TRAIN, SFT_DEV = 0.9, 0.05
UNIT = "\x1f"


def answer_of(records: DataFrame, answer_col: str | None = "answer", solution_col: str | None = None) -> tuple[Column, Column]:
    """(value, how): a record's answer and where it is from, ``answer``, ``solution`` or ``missing``.

    A source with an answer column uses that alone: strings and numbers as text, booleans and blanks not. One with a solution column has the answer
    extracted from it. Values are normalised on the surface.
    """
    none = F.lit(None).cast("string")
    if answer_col is not None:
        kind = records.schema[answer_col].dataType
        value = none if isinstance(kind, BooleanType) else F.col(answer_col).cast("string")
        found, how = F.when(F.length(text.collapse(value)) > 0, value), "answer"
    elif solution_col is not None:
        scan = answers.extractor_udf(answers.extract_solution, ("status", "value", "method"))
        found, how = scan(F.col(solution_col).cast("string"))["value"], "solution"
    else:
        return none, F.lit("missing")
    if answer_col is not None and isinstance(kind, NumericType):
        tidy = found
    else:
        tidy = F.when(found.isNotNull(), text.normalize_surface(text.canonical_text(found)))
    return tidy, F.when(found.isNotNull(), F.lit(how)).otherwise(F.lit("missing"))


def route(records: DataFrame, answer_col: str | None = "answer", solution_col: str | None = None, type_col: str | None = None) -> DataFrame:
    """Each raw record with canonical, content_key, source_hash, task_id, reference_value, answer_source and its route: ``kept`` or a quarantine reason.

    A record is kept if its problem is not blank, an answer is found, and that answer verifies against itself as its type (``type_col``; integer where there is none).
    Extraction from a solution is never ambiguous, so ``ambiguous_answer`` is for callers that extract otherwise.
    """
    out = records.withColumn("canonical", text.canonical_text(F.col("problem")))
    hashed = [c for c in ("dataset", "row_id", "problem", answer_col, solution_col) if c is not None]
    joined = F.concat(*[x for c in hashed for x in (F.lit(UNIT), F.coalesce(F.col(c).cast("string"), F.lit("")))][1:])
    out = out.withColumn("source_hash", text.sha256_hex(joined)).withColumn("content_key", text.sha256_hex(F.col("canonical")))
    out = out.withColumn("task_id", F.concat("dataset", F.lit(":"), F.left("content_key", F.lit(20))))
    value, how = answer_of(records, answer_col, solution_col)
    out = out.withColumn("reference_value", value).withColumn("answer_source", how)
    kind = F.col(type_col) if type_col else "integer"
    reason = (
        F.when(F.col("problem").isNull() | (F.col("canonical") == ""), F.lit("missing_problem"))
        .when(F.col("reference_value").isNull() | (F.col("reference_value") == ""), F.lit("missing_answer"))
        .when(~answers.self_verifies(F.col("reference_value"), kind), F.lit("unverifiable_reference"))
        .otherwise(F.lit("kept"))
    )
    return out.withColumn("route", reason)


def metadata(record: DataFrame, columns: dict[str, str]) -> Column:
    """JSON of the listed columns under their new names, in that order; only strings, numbers and booleans that are not null."""
    kinds = dict(record.dtypes)
    scalar = [(c, k) for c, k in columns.items() if c in kinds and not kinds[c].startswith(("array", "map", "struct", "binary"))]
    return F.to_json(F.struct(*[F.col(c).alias(k) for c, k in scalar])) if scalar else F.lit("{}")


def exact_dedup(tasks: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(content_key, task_id, dataset, intended_use, row_id, copies, *carry) of one task for each content key: held-out data before training data, then the smallest id.

    A min over a struct of keys: combined before the shuffle, so a text with many copies is one row from each task, and texts move only if carried.
    """
    rank = F.struct((F.col("intended_use") == "train").alias("t"), F.col("task_id"), F.col("row_id"))
    keep = ["task_id", "dataset", "intended_use", "row_id", *carry]
    best = tasks.groupBy("content_key").agg(F.min_by(F.struct(*keep), rank).alias("w"), F.count(F.lit(1)).alias("copies"))
    return best.select("content_key", "w.*", "copies")


def assign_splits(winners: DataFrame, seed: int = 7) -> DataFrame:
    """Exact 90/5/5 splits of the training tasks in the order of md5(seed:id); held-out tasks are frozen.

    Rows are numbered by digest prefix, so no sort is global; the order is independent of the input's.
    """
    train = winners.where("intended_use = 'train'").select("task_id", "dataset").withColumn("d", F.md5(F.concat(F.lit(f"{seed}:"), F.col("task_id"))))
    ranked = number_rows(train, F.left("d", F.lit(3)), [F.col("d"), F.col("task_id")], "r")
    total = train.agg(F.count(F.lit(1)).alias("n"))
    limit = lambda x: F.bround(F.col("n") * F.lit(x), 0)
    split = F.when(F.col("r") <= limit(TRAIN), "train").when(F.col("r") <= limit(TRAIN) + limit(SFT_DEV), "sft_dev").otherwise("rl_dev")
    done = ranked.join(F.broadcast(total)).select("task_id", "dataset", split.alias("split"))
    return done.unionByName(winners.where("intended_use = 'eval'").select("task_id", "dataset", F.lit("frozen_eval").alias("split")))


#: Sets of up to half as many shingles again are cut into parts alike.
STEP = 1.5
#: Texts whose shingles are counted to tell common ones from rare ones, about; and the places of that table.
COUNTED, PLACES = 20_000, 1 << 20
#: Ranges of part digests, each compared by itself.
RANGES = 1 << 10
#: Digests that a task sorts before it sends them.
FLUSH = 1 << 20
#: Texts of a block.
BLOCK = 64
#: Ids that are sent to every task; more are joined by a shuffle.
FEW = 1_000_000
#: Bytes of members of units that are on disk at a time in any case; else as many as the texts that meet have.
ROOM = 256 << 20


def _hashed(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            yield part, [text.shingle_hashes(x or "") for x in part.column(column).to_pylist()]


def _differ(size: int, threshold: float) -> int:
    """How many shingles a set and a larger one of Jaccard >= ``threshold`` may differ in, or more."""
    return int(size * (1 - threshold) / threshold + 1e-6)


def _edges(threshold: float) -> list[int]:
    """Where the bands of sizes begin; in the first, sets match only if they are equal or nearly so."""
    edges = [1, max(2, int(threshold / max(1 - threshold, 1e-9)))]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * STEP)))
    return edges


def _rarity(texts: DataFrame) -> np.ndarray:
    """How much it tells that a set has a shingle, for each value of the lowest bits of its hash: 0 for one that all sets have, 100 for one that few have.

    Counted on about ``COUNTED`` of the texts (num, canonical). The table only decides which digests are looked up first: with any table, the same similar sets meet.
    """
    spark, step = texts.sparkSession, max(1, texts.count() // COUNTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros(PLACES, np.int64), 0
        for _, sets in _hashed(batches, 0):
            for found in sets:
                held[np.unique((found & np.uint64(PLACES - 1)).astype(np.int64))] += 1
            total += len(sets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(held[at], total))], ["place", "n"])

    some = texts.where(F.pmod(F.xxhash64("num"), F.lit(step)) == 0).select("canonical")
    counts = materialise(some.mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")), "rarity")
    total = (counts.where("place = -1").agg(F.sum("n")).first()[0]) or 0
    found = counts.where((F.col("place") >= 0) & (F.col("n") * 512 > total)).toPandas()
    drop(spark, counts)
    table = np.full(PLACES, 100, np.uint8)
    table[found["place"].to_numpy()] = np.rint(-16 * np.log(np.minimum(1, found["n"].to_numpy() / max(1, total))))
    return table


def part_digests(hashes: np.ndarray, threshold: float, edges: list[int], rarity: np.ndarray | None = None) -> np.ndarray:
    """64-bit digests of parts of a set of sorted hashes; two sets of Jaccard >= ``threshold`` have one in common.

    The range of hashes is cut into more parts than the d = ``_differ`` shingles by which two sets may differ, as many for all sizes of a band, so of any d + 1 parts of one set one is
    equal in the other. A set gives its first d + 1 parts that are not empty, in the order of what they tell (the sum of ``rarity``, which depends on a part's shingles alone; else their number) and then of place.
    Of two similar sets, take the one whose last given part comes first: one of its given parts is equal in the other, where it is given as well, since it comes before the last one there.
    A set that has fewer parts gives them all, and a mark, by which it meets others that have too few.
    A pair meets in the band of the smaller: a set takes part in its own band and those that a smaller match may lie in.
    """
    n, out = len(hashes), []
    mixed = hashes * np.uint64(0x9FB21C651E98DF25)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(29)
    telling = np.ones(n, np.int64) if rarity is None else rarity[(hashes & np.uint64(len(rarity) - 1)).astype(np.int64)].astype(np.int64)
    for band in range(bisect_right(edges, max(1, int(np.ceil(n * threshold - 1e-6)))) - 1, bisect_right(edges, n)):
        most = _differ(edges[band + 1] - 1, threshold) + 1
        need, count = min(_differ(n, threshold) + 1, most), 1 if most == 1 else most + 2 + most // 8
        at = np.append(np.searchsorted(hashes, np.arange(count, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // count)), n)
        full = np.flatnonzero(np.diff(at))
        lot = np.argsort(-np.add.reduceat(telling, at[full]), kind="stable")[:need]
        x = np.add.reduceat(mixed, at[full])[lot] + np.uint64((2 * band + 1) * 0xD6E8FEB86659FD93 % (1 << 64)) + full[lot].astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        out.append(x ^ (x >> np.uint64(30)))
        if len(lot) < need:
            out.append(np.array([band], np.uint64))
    return np.concatenate(out)


def _planes(values: np.ndarray, places: slice) -> np.ndarray:
    """Bytes of little-endian values, those of one place side by side, in which the upper ones repeat."""
    return values.view(np.uint8).reshape(-1, 8)[:, places].T


def _values(planes: bytes, places: slice) -> np.ndarray:
    width = len(range(*places.indices(8)))
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, places] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return out.view(np.uint64).ravel()


#: Bytes of a digest that are sent (its range is known), and of an id.
_DIGEST, _NUM = slice(0, 5), slice(0, 8)


def _meeting(texts: DataFrame, threshold: float) -> DataFrame:
    """(key, num, least) of the digests that several texts of (num, canonical) have in common; ``least``: the smallest of their numbers.

    Digests are many, about an eighth of the shingles, and few meet: they are sent sorted, by range, as bytes, and each range is compared by itself.
    """
    edges, rarity = _edges(threshold), texts.sparkSession.sparkContext.broadcast(_rarity(texts))

    def send(digests: list[np.ndarray], nums: list[int]) -> pa.RecordBatch:
        keys, of = np.concatenate(digests), np.repeat(np.array(nums, np.int64), [len(x) for x in digests])
        order = np.argsort(keys)
        keys, of = keys[order], of[order]
        ranges = (keys >> np.uint64(54)).astype(np.int64)
        begins = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1]))
        keys = keys >> np.uint64(14)  # ten bits of range and forty more
        rows = [(int(ranges[a]), _planes(keys[a:b], _DIGEST).tobytes(), _planes(of[a:b], _NUM).tobytes()) for a, b in zip(begins, [*begins[1:], len(keys)])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["r", "keys", "nums"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, nums, held = [], [], 0
        for part, sets in _hashed(batches, 1):
            for num, found in zip(part.column(0).to_pylist(), sets):
                digests.append(part_digests(found, threshold, edges, rarity.value))
                nums.append(num)
                held += len(digests[-1])
            if held > FLUSH:
                yield send(digests, nums)
                digests, nums, held = [], [], 0
        if nums:
            yield send(digests, nums)

    def meet(table: pa.Table) -> pa.Table:
        keys = np.concatenate([_values(x, _DIGEST) for x in table["keys"].to_pylist()])
        nums = np.concatenate([_values(x, _NUM) for x in table["nums"].to_pylist()]).view(np.int64)
        order = np.lexsort((nums, keys))
        keys, nums = keys[order], nums[order]
        begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(begins, len(keys)))
        n = np.repeat(sizes, sizes)
        kept = n > 1
        whole = keys[kept].view(np.int64) + (table["r"][0].as_py() << 40)
        return pa.table([whole, nums[kept], np.repeat(nums[begins], sizes)[kept]], ["key", "num", "least"])

    return texts.select("num", "canonical").mapInArrow(cut, "r long, keys binary, nums binary").groupBy("r").applyInArrow(meet, "key long, num long, least long")


def _sketch(hashes: np.ndarray) -> bytes:
    """For each value of the lowest bits of a hash, whether an odd number of hashes has it: sets differ in at least as many hashes as in these bits."""
    width = max(64, 1 << (len(hashes) // 2).bit_length())
    return np.packbits((np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def _apart(one: bytes, other: bytes) -> int:
    """In how many bits two sketches differ; the wider one is folded."""
    short, wide = sorted((np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(wide.reshape(-1, len(short)), axis=0) ^ short).sum())


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that are sorted by unit (x, y), cut only between units."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
        edges = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        if held and len(batch) and (held[-1].column("x")[0].as_py(), held[-1].column("y")[0].as_py()) != (x[0], y[0]):
            yield joined()
            held = []
        if len(edges):
            held.append(batch.slice(0, int(edges[-1])))
            yield joined()
            held = [batch.slice(int(edges[-1]))]
        elif len(batch):
            held.append(batch)
    if held:
        yield joined()


def near_pairs(texts: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(a, b, common, total) of all pairs a < b of (id, canonical) whose 5-character shingle sets have Jaccard >= threshold.

    Exact: sets are cut into more parts than similar ones may have differences, so these have an equal part (``part_digests``). Texts that meet are dealt
    to blocks of about ``BLOCK`` of like sizes, those that meet the same text together, and two blocks of which some texts meet are a unit, compared by one task: first by sizes and sketches, which turn away only what
    cannot be similar, then by whole sets, made again from the texts, which are smaller. So a text moves once for each block that it meets, not for each text.
    Texts meet by chance as well, the more often the more there are, so units are made and compared in rounds: those of a round take no more disk than the texts that meet, or ``ROOM``.
    Texts may bring a column ``num`` of their own numbers (long), if they are stored; else they are stored here.
    """
    spark, kind = texts.sparkSession, dict(texts.dtypes)["id"]
    own = None
    if "num" not in texts.columns:
        texts = own = materialise(texts.select("id", "canonical", F.monotonically_increasing_id().alias("num")), "texts")
    met = materialise(_meeting(texts, threshold), "met")
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _hashed(batches, 1):
            packed = [zlib.compress((x or "").encode("utf-8", "surrogatepass")) for x in part.column(1).to_pylist()]
            made = (([len(v) for v in sets], pa.int64()), ([_sketch(v) for v in sets], pa.binary()), (packed, pa.binary()))
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), *(pa.array(v, t) for v, t in made)], ["num", "id", "n", "sketch", "packed"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_units(batches):
            x, y, nums, sides, size = (batch.column(c).to_numpy() for c in ("x", "y", "num", "own", "n"))
            sketch, out = batch.column("sketch").to_pylist(), []
            edges = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))).tolist()
            for a, b in zip(edges, [*edges[1:], len(x)]):
                order = nums if x[a] == y[a] else sides
                for i in range(a, b):
                    fit = (np.minimum(size[a:b], size[i]) >= np.maximum(size[a:b], size[i]) * threshold - 1e-6) & (order[a:b] > order[i])
                    out += [(i, j) for j in (np.flatnonzero(fit) + a).tolist() if _apart(sketch[i], sketch[j]) <= (size[i] + size[j]) * (1 - threshold) / (1 + threshold) + 1e-6]
            i, j = np.array(out, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x[i], y[i], nums[i], nums[j])], ["x", "y", "i", "j"])

    def compare(pairs: pa.Table, members: pa.Table) -> pa.Table:
        packed, ids = (dict(zip(members["num"].to_pylist(), members[c].to_pylist())) for c in ("packed", "id"))
        found = lru_cache(2 * BLOCK)(lambda num: text.shingle_hashes(zlib.decompress(packed[num]).decode("utf-8", "surrogatepass")))
        out = []
        for i, j in zip(pairs["i"].to_pylist(), pairs["j"].to_pylist()):
            both = np.concatenate([found(i), found(j)])
            both.sort(kind="stable")
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if common >= (len(both) - common) * threshold:
                out.append((*sorted((ids[i], ids[j])), common, len(both) - common))
        columns = zip(*out) if out else ((), (), (), ())
        return pa.table([pa.array(c, t) for c, t in zip(columns, (members["id"].type, members["id"].type, pa.int64(), pa.int64()))], ["a", "b", "common", "total"])

    spread = max(-math.log(threshold), 1e-9) * (1 + 1e-9)  # sizes of similar sets are at most one class apart
    labels = met.groupBy("num").agg(F.min("least").alias("label"))
    ends = materialise(labels, "ends")
    few = ends.count() <= FEW
    held = texts.select("id", "canonical", "num").join(F.broadcast(ends.select("num")) if few else ends.select("num"), "num", "left_semi").select("id", "canonical", "num")
    held = materialise(held.mapInArrow(sketches, f"num long, id {kind}, n long, sketch binary, packed binary"), "sketches")
    crowds = ends.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    dealt = join_counted(ends, crowds, ["label"], F.col("num"), "n", hot_limit(ends.count(), spark)).withColumnRenamed("n", "crowd")
    sized = dealt.join(held.select("num", F.floor(F.log("n") / spread).alias("size")), "num")
    blocks = materialise(sized.select("num", "size", F.xxhash64("label", "size", F.pmod(F.xxhash64("num"), F.ceil(F.col("crowd") / BLOCK))).alias("own")), "blocks")
    placed = materialise(met.select("key", "num").join(F.broadcast(blocks) if few else blocks, "num"), "placed")
    drop(spark, met)
    others = placed.select("key", F.col("own").alias("other"), F.col("size").alias("other_size")).distinct()
    unit = (F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    units = placed.join(others, "key").where(F.abs(F.col("size") - F.col("other_size")) <= 1).select(*unit, "num", "own")
    turn = F.xxhash64("y", "x")

    def filled(members: DataFrame, *columns: str) -> DataFrame:
        uses = members.groupBy("num").agg(F.count(F.lit(1)).alias("__n")).join(held.select("num", *columns), "num")
        return join_counted(members, uses, ["num"], F.xxhash64("x", "y"), "__n", hot_limit(members.count(), spark)).drop("__n")

    bulk, each = held.agg(F.sum(F.octet_length("packed") + F.octet_length("sketch")), F.avg(F.octet_length("sketch") + 40)).first()
    room = max(ROOM, bulk or 0)
    rounds = 1
    if (placed.groupBy("key").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0) * each > room:  # an upper limit; else a part of the units is counted
        rounds = math.ceil(64 * units.where(F.pmod(turn, F.lit(64)) == 0).distinct().count() * each / room) or 1
    found = []
    for k in range(rounds):
        own_units = materialise(units.where(F.pmod(F.shiftright(turn, 6), F.lit(rounds)) == k).distinct(), "units")
        full = filled(own_units, "n", "sketch").select("x", "y", "num", "own", "n", "sketch").repartition("x", "y").sortWithinPartitions("x", "y")
        found.append(materialise(full.mapInArrow(close, "x long, y long, i long, j long"), "close"))
        drop(spark, own_units)
    pairs = reduce(DataFrame.unionAll, found)
    members = materialise(pairs.select("x", "y", F.explode(F.array("i", "j")).alias("num")).distinct(), "members")
    full = pairs.groupBy("x", "y").cogroup(filled(members, "id", "packed").groupBy("x", "y"))
    done = materialise(full.applyInArrow(compare, f"a {kind}, b {kind}, common long, total long"), "near")
    for used in (own, ends, blocks, placed, held, members, *found):
        if used is not None:
            drop(spark, used)
    return done


def id_digest(ids: DataFrame, by: str, column: str) -> DataFrame:
    """(by, n, digest): sha256 over the sorted ids of each group, joined by line feeds.

    Ids are sorted by Spark, which spills, and hashed as they stream past: no group is gathered in memory. A digest over one text is made in its order, so by one task for each group.
    Null ids are left out, as is a group that has no others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, n, state = None, 0, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([group, pa.array([n], pa.int64()), pa.array([state.hexdigest()])], [by, "n", "digest"])

        for batch in batches:
            owners = batch.column(0).to_pylist()
            edges = [0, *(i for i in range(1, len(owners)) if owners[i] != owners[i - 1]), len(owners)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if n and group[0].as_py() != owners[a]:
                    yield done()
                    n = 0
                if not n:
                    group, state = batch.column(0).slice(a, 1), hashlib.sha256()
                text_ = "\n".join(batch.column(1).slice(a, b - a).to_pylist())
                state.update((("\n" if n else "") + text_).encode())
                n += b - a
        if n:
            yield done()

    kept = ids.select(by, F.col(column).cast("string").alias("id")).where("id is not null")
    return kept.repartition(by).sortWithinPartitions(by, "id").mapInArrow(run, f"{by} {dict(ids.dtypes)[by]}, n long, digest string")


def audit_splits(rows: DataFrame, kind: str = "integer") -> DataFrame:
    """(split, n, digest, repeated, across, leaked, unverifiable) of rows (split, task_id, reference_value).

    ``repeated``: rows beyond the first of an id within the split; ``across``: rows whose id is in other splits as well; ``leaked``: held-out rows whose id is in
    another split; ``unverifiable``: references that do not verify against themselves as ``kind``. One row for each id is made first, so no split is gathered.
    """
    good = answers.self_verifies(F.col("reference_value"), kind)
    marked = rows.select("task_id", "split", F.coalesce(good, F.lit(False)).alias("good"))
    ids = marked.groupBy("task_id", "split").agg(F.count(F.lit(1)).alias("c"), F.count_if(~F.col("good")).alias("bad"))
    per_id = ids.groupBy("task_id").agg(F.collect_list(F.struct("split", "c", "bad")).alias("in"))  # at most one for each split
    each = per_id.select(F.explode("in").alias("x"), (F.size("in") > 1).alias("shared"))
    sums = each.groupBy("x.split").agg(F.sum("x.c").alias("n"), F.sum(F.col("x.c") - 1).alias("repeated"), F.sum(F.when(F.col("shared"), F.col("x.c")).otherwise(0)).alias("across"), F.sum(F.when(F.col("shared") & (F.col("x.split") == "frozen_eval"), F.col("x.c")).otherwise(0)).alias("leaked"), F.sum("x.bad").alias("unverifiable"))
    return sums.join(id_digest(rows, "split", "task_id").drop("n"), "split").select("split", "n", "digest", "repeated", "across", "leaked", "unverifiable")
