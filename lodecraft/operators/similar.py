"""Near-duplicates: links by banded signatures, each confirmed, and a greedy choice of what stays."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..storage import drop, materialise
from .corpus import FEW, _sketch, near_pairs
from .skew import hot_limit, join_counted

_U = np.uint64
#: Classes of a block: members of a larger bucket are compared block by block.
BLOCK = 512
#: Bytes of sets of shingles that a task holds.
SETS = 64 << 20


def permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of ``count`` seeded bijections of 64-bit values."""
    draw = np.random.default_rng(seed)
    return draw.integers(0, 1 << 63, count, dtype=_U) * _U(2) + _U(1), draw.integers(0, 1 << 63, count, dtype=_U)


def minhash(hashes: np.ndarray, factors: np.ndarray, summands: np.ndarray) -> np.ndarray:
    """The least value of each bijection over a set of hashes, by its upper 32 bits."""
    least = np.full(len(factors), np.iinfo(_U).max, _U)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * factors + summands).min(axis=0), out=least)
    return (least >> _U(32)).astype(np.uint32)


def signatures(texts: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """(id, set_hash, n, signature) of (id, canonical): ``count`` 32-bit MinHash values of the set of 5-character shingles, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = permutations(count, seed)
        for batch in batches:
            sets = [text.shingle_hashes(x or "") for x in batch.column(1).to_pylist()]
            columns = [[hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], [len(s) for s in sets], [minhash(s, *family).tobytes() for s in sets]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary())))], ["id", "set_hash", "n", "signature"])

    return texts.select("id", "canonical").mapInArrow(run, f"id {dict(texts.dtypes)['id']}, set_hash binary, n long, signature binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit, the first column of batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        unit = batch.column(0)
        keys = np.column_stack([unit.field(i).to_numpy() for i in range(unit.type.num_fields)])
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        for k, (start, stop) in enumerate(zip(edges, edges[1:])):
            part = batch.slice(start, stop - start)
            if held and (k or held[-1].column(0)[0] != unit[0]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _first_met(group: pa.Table, bands: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of a unit (digests, n, side, perhaps sketch) the later ones that it meets in no band before this one, and whose sizes and sketches do not tell that they cannot be similar."""
    sketches = _apart_from(group) if "sketch" in group.column_names else None
    digests, size, side = np.frombuffer(b"".join(group["digests"].to_pylist()), np.uint32).reshape(-1, bands), group["n"].to_numpy(), group["side"].to_numpy()
    band = group["unit"][0]["band"].as_py()
    for i in range(len(size) - 1):
        fit = ((side[i + 1 :] != side[i]) | (side[i] == 2)) & (np.minimum(size[i + 1 :], size[i]) >= threshold * np.maximum(size[i + 1 :], size[i]) - 1e-9)
        others = np.flatnonzero(fit) + i + 1
        if len(others) and band:
            others = others[~(digests[others, :band] == digests[i, :band]).any(axis=1)]
        if len(others) and sketches is not None:
            others = others[sketches(i, others) <= (size[others] + size[i]) * (1 - threshold) / (1 + threshold) + 1e-6]
        if len(others):
            yield i, others


def _apart_from(group: pa.Table) -> Callable[[int, np.ndarray], np.ndarray]:
    """In how many bits the sketch of a member differs from those of others at least (``_apart``)."""
    own = group["sketch"].to_pylist()
    width = np.array([len(x) for x in own])
    place, tables = np.zeros(len(own), np.int64), {}
    for w in set(width.tolist()):
        at = np.flatnonzero(width == w)
        place[at] = np.arange(len(at))
        tables[w] = np.frombuffer(b"".join(own[k] for k in at), _U).reshape(len(at), -1)

    def apart(i: int, others: np.ndarray) -> np.ndarray:
        one, out = tables[width[i]][place[i]], np.zeros(len(others), np.int64)
        for w in set(width[others].tolist()):
            at = np.flatnonzero(width[others] == w)
            rest, short = tables[w][place[others[at]]], min(w // 8, len(one))
            while rest.shape[1] > short:  # widths are powers of 2
                half = rest.shape[1] // 2
                rest = rest[:, :half] ^ rest[:, half:]
            out[at] = np.bitwise_count(rest ^ np.bitwise_xor.reduce(one.reshape(-1, short), axis=0)).sum(axis=1)
        return out

    return apart


def _confirmed(group: pa.Table, bands: int, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, common, total) of the similar pairs of a unit: whole sets are compared, of which ``SETS`` bytes are held."""
    packed = group["packed"]
    sets: dict[int, np.ndarray] = {}
    room = SETS

    def found(i: int) -> np.ndarray:
        nonlocal room
        if i not in sets:
            made = text.shingle_hashes(zlib.decompress(packed[i].as_py()).decode("utf-8", "surrogatepass"))
            room -= made.nbytes
            if room < 0:
                sets.clear()
                room = SETS - made.nbytes
            sets[i] = made
        return sets[i]

    for i, others in _first_met(group, bands, threshold):
        one = found(i)
        for j in others.tolist():
            both = np.concatenate([one, found(j)])
            both.sort(kind="stable")
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if common >= threshold * (len(both) - common) - 1e-9:
                yield i, j, common, len(both) - common


def _met(texts: DataFrame, classes: DataFrame, bands: int, threshold: float, pairs: bool) -> DataFrame:
    """Confirmed pairs of classes, or how many texts each class is linked with.

    A bucket's classes, or two blocks of a large one's, are a unit. First digests alone decide who meets somebody there for the first time, then sketches who may be similar; only these bring their texts, packed.
    So a text moves once for each unit in which it has a pair to be compared, and no pair is written but those asked for.
    """
    spark, kind = texts.sparkSession, dict(texts.dtypes)["id"]
    each = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.substring(F.col("digests"), b * 4 + 1, F.lit(4)).alias("key")))
    keys = classes.select("num", F.explode(each).alias("k")).select("num", "k.band", F.conv(F.hex("k.key"), 16, 10).cast("long").alias("key"))
    crowds = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    members = join_counted(keys, crowds, ["band", "key"], F.col("num"), "met", hot_limit(classes.count() * bands, spark)).select("num", "band", "key", "met")
    blocks = F.ceil(F.col("met") / BLOCK)
    own = F.pmod(F.xxhash64("num"), blocks)
    dealt = members.select("num", "band", "key", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    unit = F.struct("band", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = materialise(dealt.select(unit.alias("unit"), side.alias("side"), "num"), "units")

    def filled(rows: DataFrame, own: DataFrame) -> DataFrame:
        uses = rows.groupBy("num").agg(F.count(F.lit(1)).alias("uses")).join(own, "num")
        full = join_counted(rows, uses, ["num"], F.xxhash64("unit"), "uses", hot_limit(rows.count(), spark)).drop("uses")
        return full.select("unit", *[c for c in full.columns if c != "unit"]).repartition("unit").sortWithinPartitions("unit")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            takes = np.zeros(len(group), bool)
            for i, others in _first_met(group, bands, threshold):
                takes[i] = takes[others] = True
            if takes.any():
                yield from group.select(["unit", "side", "num"]).filter(pa.array(takes)).combine_chunks().to_batches()

    shape = "unit struct<band:int,key:long,x:long,y:long>, side int, num long"
    taking = materialise(filled(dealt, classes.select("num", "n", "digests")).mapInArrow(meet, shape), "taking")
    ends = taking.select("num").distinct().join(classes.select("num", F.col("rid").alias("id")), "num")
    ends = materialise(ends, "ends")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [x or "" for x in batch.column(2).to_pylist()]
            made = ([zlib.compress(x.encode("utf-8", "surrogatepass")) for x in values], [_sketch(text.shingle_hashes(x)) for x in values])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, pa.binary()) for x in made)], ["num", "id", "packed", "sketch"])

    needed = texts.select("id", "canonical").join(F.broadcast(ends) if ends.count() <= FEW else ends, "id").select("num", "id", "canonical")
    packed = materialise(needed.mapInArrow(pack, f"num long, id {kind}, packed binary, sketch binary"), "packed")
    known = packed.join(classes.select("num", "n", "digests", "copies"), "num")
    alike = materialise(filled(taking, known.select("num", "n", "digests", "sketch")).mapInArrow(meet, shape), "alike")
    full = filled(alike, known)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            ids, copies = group["id"].combine_chunks(), group["copies"].to_pylist()
            found = list(_confirmed(group, bands, threshold))
            if pairs and found:
                a, b = zip(*((i, j) if ids[i].as_py() < ids[j].as_py() else (j, i) for i, j, _, _ in found))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), *(pa.array([p[k] for p in found], pa.int64()) for k in (2, 3))], ["a", "b", "common", "total"])
            elif found:
                links = np.zeros(len(group), np.int64)
                for i, j, _, _ in found:
                    links[i] += copies[j]
                    links[j] += copies[i]
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(links[at])], ["rid", "links"])

    schema = f"a {kind}, b {kind}, common long, total long" if pairs else f"rid {kind}, links long"
    out = materialise(full.mapInArrow(compare, schema), "met")
    for used in (dealt, taking, ends, packed, alike):
        drop(spark, used)
    return out


def _classes(texts: DataFrame, bands: int, rows: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Each text with its set's hash, and the classes: their number, smallest id, size, copies and a 32-bit digest of each band. Classes meet where digests are equal; what that adds is confirmed like all."""
    digest = lambda b: F.unhex(F.lpad(F.hex(F.xxhash64(F.substring(F.col("signature"), b * (4 * rows) + 1, F.lit(4 * rows))).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    digests = F.concat(*[digest(F.lit(b)) for b in range(bands)])
    signed = materialise(signatures(texts, bands * rows, seed).select("id", "set_hash", "n", digests.alias("digests")), "signatures")
    classes = signed.groupBy("set_hash").agg(F.min("id").alias("rid"), F.first("n").alias("n"), F.first("digests").alias("digests"), F.count(F.lit(1)).alias("copies"))
    return signed, materialise(classes.withColumn("num", F.monotonically_increasing_id()), "classes")


def lsh_pairs(texts: DataFrame, bands: int = 20, rows: int = 4, threshold: float = 0.9, seed: int = 42) -> DataFrame:
    """(a, b, common, total): the pairs of class representatives a < b of (id, canonical) that share a band and have Jaccard >= ``threshold``.

    A class is all texts with one set of shingles; its smallest id stands for it. The rest is as in ``lsh_links``.
    """
    texts = materialise(texts.select("id", "canonical"), "texts")
    signed, classes = _classes(texts, bands, rows, seed)
    out = _met(texts, classes, bands, threshold, True)
    for used in (texts, signed, classes):
        drop(texts.sparkSession, used)
    return out


def lsh_links(texts: DataFrame, bands: int = 20, rows: int = 4, threshold: float = 0.9, seed: int = 42) -> DataFrame:
    """(id, class_id, copies, links) of each text of (id, canonical): with how many others it has Jaccard >= ``threshold``, found by banding and confirmed.

    Texts meet when all MinHash values of some band agree. Texts with one set of shingles are one class (``class_id``: its smallest id), compared once and linked with each other.
    Every two classes of a bucket are compared, a large bucket by pairs of blocks of ``BLOCK`` classes, each of bounded size (``_met``); what
    comes out is a number for each class, not the pairs. A pair at the threshold shares no band with a probability of (1 - threshold**rows)**bands: 5e-10 by default.
    ids must be unique and not null; a null text is empty.
    """
    spark = texts.sparkSession
    texts = materialise(texts.select("id", "canonical"), "texts")
    signed, classes = _classes(texts, bands, rows, seed)
    met = _met(texts, classes, bands, threshold, False)
    drop(spark, texts)
    links = classes.join(met.groupBy("rid").agg(F.sum("links").alias("links")), "rid", "left").select("set_hash", F.col("rid").alias("class_id"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return join_counted(signed.select("id", "set_hash"), links, ["set_hash"], F.col("id"), "copies", hot_limit(signed.count(), spark)).select("id", "class_id", "copies", "links")


def greedy_removed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key) of the nodes that a greedy choice along the order of keys removes.

    ``nodes``: (key, rank); ``pairs``: (a, b) of keys. In the order of keys, each node that is still there meets its neighbours that are; the one of smallest rank stays, the others go.

    Done in rounds that give the sequential result: a node's turn depends only on what is still there within two links of it, so all nodes that are the least of that
    neighbourhood take their turns at once; they share no neighbour. Nodes that are gone leave the table of links. With keys in random order (digests) the rounds
    are few, about the logarithm of the longest dependency, and each is aggregates and joins over the links that are left, hubs dealt to several tasks.
    """
    spark = pairs.sparkSession
    both = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    links = materialise(both.join(nodes.select(F.col("key").alias("b"), F.col("rank").alias("rank_b")), "b").join(nodes.select(F.col("key").alias("a"), F.col("rank").alias("rank_a")), "a").select("a", "b", "rank_a", "rank_b"), "links")
    removed, used = None, []
    while left := links.count():
        limit = hot_limit(left, spark)
        near = links.groupBy("a").agg(F.least("a", F.min("b")).alias("least"), F.least(F.first("rank_a"), F.min("rank_b")).alias("best"), F.first("rank_a").alias("rank"), F.count(F.lit(1)).alias("n"))
        near = materialise(near, "near")
        beyond = join_counted(links, near.select(F.col("a").alias("b"), F.col("least").alias("far"), "n"), ["b"], F.col("a"), "n", limit)
        turns = beyond.groupBy("a").agg(F.min("far").alias("far")).join(near, "a").where((F.col("far") == F.col("a")) & (F.col("least") == F.col("a"))).select("a", "best", "rank", "n")
        turns = materialise(turns, "turns")
        reached = join_counted(links, turns.select("a", "best", "n"), ["a"], F.col("b"), "n", limit).where("rank_b <> best").select(F.col("b").alias("key"))
        gone = materialise(reached.unionAll(turns.where("rank <> best").select(F.col("a").alias("key"))).distinct(), "gone")
        used.append(gone)
        removed = gone if removed is None else removed.unionAll(gone)
        for end in ("a", "b"):
            flags = near.select(F.col("a").alias(end), "n").join(gone.select(F.col("key").alias(end), F.lit(True).alias("is_gone")), end)
            links, before = join_counted(links, flags, [end], F.col("b" if end == "a" else "a"), "n", limit, "left").where("is_gone is null").select("a", "b", "rank_a", "rank_b"), links
        links = materialise(links, "links")
        for table in (near, turns):
            drop(spark, table)
    drop(spark, links)
    return spark.createDataFrame([], f"key {dict(nodes.dtypes)['key']}") if removed is None else removed


def near_dedup(winners: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(task_id, dataset, content_key) of ``winners`` without near-duplicates, greedily in the order of content keys (``greedy_removed``).

    Of a task and its near ones that are left, held-out data stay before training data, then the smaller id. Near: Jaccard of 5-character shingles >= ``threshold``, exactly.
    """
    base = materialise(winners.select("task_id", "dataset", "content_key", "canonical", F.struct((F.col("intended_use") == "train").alias("train"), "task_id").alias("rank"), F.monotonically_increasing_id().alias("num")), "winners")
    pairs = near_pairs(base.select(F.col("content_key").alias("id"), "canonical", "num"), threshold)
    gone = greedy_removed(pairs, base.select(F.col("content_key").alias("key"), "rank"))
    drop(winners.sparkSession, pairs)
    return base.join(gone.withColumnRenamed("key", "content_key"), "content_key", "left_anti").select("task_id", "dataset", "content_key")
