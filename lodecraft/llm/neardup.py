"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index, then confirmed on whole sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.skew import hot_limit, join_counted
from ..storage import drop, materialise
from .words import blocks, mix, shingle_sets

_U = np.uint64
#: Positions of a chunk: with 8 bits each, a chunk is one 64-bit value.
WIDTH = 8
#: Of a bucket in which not all members are in one component yet: up to so many members, pairs are listed; more are compared in blocks.
SMALL = 32
#: Shingles, over all sets, on either side of a block comparison.
SIDE = 50_000
#: Ids that may be broadcast: at most 16 MB.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Plan:
    """How signatures are made and joined.

    A signature is ``chunks * WIDTH`` MinHash values of 8 bits. Documents whose signatures differ in at most
    ``radius`` = 2 * chunks - 1 places have, by the pigeonhole principle, a chunk with at most one error; each
    chunk is indexed under every way to leave one of its places out, so they meet in a bucket for certain. Pairs further
    apart meet when their errors fall well; ``chunks`` is the smallest number with which a pair exactly at the
    threshold meets nowhere with probability under ``miss``. What meets is judged exactly: by sizes and parities (``may_be_close``), which
    only turn away pairs that cannot be similar enough, then by whole sets.

    ``exact`` finds every pair: instead of chunks, the index holds the (100 - per_cent) per cent of each set's shingles, and one more, that are least by hash. Two sets
    that are similar enough share one of those for certain (all sets being in one order, what they share cannot lie in the rests alone). That is several times as many keys.
    """

    n: int = 5
    per_cent: int = 80
    miss: float = 5e-5
    exact: bool = False

    @property
    def chunks(self) -> int:
        t = self.per_cent / 100
        meets = t**WIDTH + WIDTH * (1 - t) * t ** (WIDTH - 1)
        return max(2, math.ceil(math.log(self.miss) / math.log(1 - meets))) if meets < 1 else 2

    @property
    def places(self) -> int:
        return self.chunks * WIDTH

    @property
    def radius(self) -> int:
        return 2 * self.chunks - 1


def _hash_family(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * k + 1, dtype=_U) * _U(0x632BE59BD9B4E019))
    return seeds[:k] | _U(1), seeds[k:]


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The lowest 8 bits of each minimum."""
    a, b = family
    least = np.full(len(a), np.iinfo(_U).max, _U)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at : at + 2048, None] * a + b).min(axis=0), out=least)
    return (mix(least) & _U(255)).astype(np.uint8).tobytes()


def parities(shingles: np.ndarray) -> bytes:
    """The size of a set, then for each of 2 to 4 times as many bits (a power of 2) whether an odd number of shingles falls on it."""
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return len(shingles).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_close(one: bytes, other: bytes, per_cent: int) -> bool:
    """Whether two sets can have the similarity, by their ``parities``: false only if they cannot.

    The sum of two parities is that of the shingles in one set only, so each odd bit stands for such a shingle at least; at the threshold there are at most
    (100 - per_cent) / (100 + per_cent) times the sizes' sum of them. The longer parities are folded to the length of the shorter.
    """
    n, m = int.from_bytes(one[:8], "little"), int.from_bytes(other[:8], "little")
    if 100 * min(n, m) < per_cent * max(n, m):
        return False
    a, b = np.frombuffer(one, _U, offset=8), np.frombuffer(other, _U, offset=8)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) * (100 + per_cent) <= (n + m) * (100 - per_cent)


def signatures(docs: DataFrame, id_col: str, text_col: str, plan: Plan) -> DataFrame:
    """(doc_id, n_shingles, set_hash, sig, probe) of each row; the last three, binary, are null where the set is empty. ``probe``: ``parities``."""
    n, k = plan.n, plan.places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = _hash_family(k)
        for batch in batches:
            size, digest, sig, probe = [0] * len(batch), [None] * len(batch), [None] * len(batch), [None] * len(batch)
            for block in blocks(batch.column(1)):
                for row, s in shingle_sets(block, n):
                    size[row] = len(s)
                    if len(s):
                        digest[row] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                        sig[row] = s[: len(s) + 1 + -plan.per_cent * len(s) // 100].tobytes() if plan.exact else signature(s, family)
                        probe[row] = parities(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, sig, probe))], ["doc_id", "n_shingles", "set_hash", "sig", "probe"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, sig binary, probe binary")


def index_keys(classes: DataFrame, plan: Plan) -> DataFrame:
    """(key, rid): each chunk of each signature, with each of its places left out in turn; or each shingle of an exact plan's signature."""
    m = plan.chunks

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch.column(1).to_pylist()], np.int64)
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes))], ["key", "rid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ~(_U(255) << (_U(8) * np.arange(WIDTH, dtype=_U)))
        salt = mix(np.arange(1, m * WIDTH + 1, dtype=_U)).reshape(m, WIDTH)
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                rid = part.column(0).to_numpy(zero_copy_only=False)
                chunk = np.frombuffer(b"".join(part.column(1).to_pylist()), _U).reshape(len(part), m)
                keys = mix((chunk[:, :, None] & kept) ^ salt).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(rid, m * WIDTH))], ["key", "rid"])

    return classes.select("rid", "sig").mapInArrow(prefixes if plan.exact else run, "key long, rid long")


def shingle_arrays(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, plan: Plan) -> DataFrame:
    """(rid, shingles binary) of the wanted ids: sorted distinct 64-bit hashes.

    The wanted ids go to every executor only if there are at most ``BROADCAST_IDS`` of them, and with them no text
    is shuffled; if there are more, ids and texts are joined by a shuffle.
    """
    n = plan.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets = [s.tobytes() for _, s in shingle_sets(block, n)]
                ids = batch.column(0).slice(block.rows.start, len(block.rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.binary())], ["rid", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("rid"), F.col(text_col).cast("string").alias("text"))
    return _of_ids(rows, wanted).mapInArrow(run, "rid long, shingles binary")


def _ends(pairs: DataFrame, table: DataFrame, column: str, limit: int | None) -> DataFrame:
    """(a, b, column of a, column of b) for each pair. An id may be the ``a`` of most pairs, so its pairs are dealt to several tasks;
    it is the ``b`` of at most as many as a document has keys times ``SMALL``."""
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(table.select(F.col("rid").alias("a"), F.col(column).alias("left")), "a")
    partners = pairs.join(table.select(F.col("rid").alias("b"), F.col(column).alias("right")), "b")
    return join_counted(partners, hubs, ["a"], F.col("b"), "n", limit).select("a", "b", "left", "right")


def _within(pairs: DataFrame, classes: DataFrame, plan: Plan, limit: int | None) -> DataFrame:
    """The pairs (a, b) whose sets may be similar enough; an id that stands for several classes may always be."""
    per_cent = plan.per_cent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = pa.array([x is None or y is None or may_be_close(x, y, per_cent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    return _ends(pairs, classes, "probe", limit).mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, plan: Plan, limit: int | None) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    per_cent = plan.per_cent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                both = np.concatenate([np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * common >= per_cent * (len(both) - common))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return _ends(pairs, sets, "shingles", limit).mapInArrow(run, "a long, b long")


def _of_ids(table: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``table`` with one of the ``rid`` in ``ids``: these go to every executor if there are at most ``BROADCAST_IDS`` of them, and then ``table`` is not moved."""
    return table.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "rid", how)


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, plan: Plan) -> DataFrame:
    """The confirmed pairs of ``pairs``, which is written."""
    spark = docs.sparkSession
    n = pairs.count()
    if not n:
        return pairs
    limit = hot_limit(n, spark)
    met = materialise(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "met")
    one = F.count(F.lit(1)) == 1  # an id with several texts may stand for several classes
    probes = _of_ids(classes.select("rid", "probe"), met).groupBy("rid").agg(F.when(one, F.min("probe")).alias("probe"))
    near = materialise(_within(pairs, probes, plan, limit), "near")
    ends = materialise(near.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "ends")
    sets = materialise(shingle_arrays(docs, id_col, text_col, ends, plan), "sets")
    links = materialise(_confirmed(near, sets, plan, limit), "links")
    for used in (pairs, met, near, ends, sets):
        drop(spark, used)
    return links


def _compare_blocks(per_cent: int):
    """Links between two sides of sets (side 0 and 1), or within one (side 2), as a forest: no link inside a known component."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        arrays = [np.frombuffer(x, _U) for x in part["shingles"]]
        sizes = np.array([len(x) for x in arrays])
        _, flat = np.unique(np.concatenate(arrays), return_inverse=True)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        side, rid, root = (part[c].to_numpy() for c in ("side", "rid", "root"))
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        right = np.flatnonzero(side != 0)
        places = np.concatenate([flat[offsets[j] : offsets[j + 1]] for j in right]) if len(right) else flat[:0]
        begins = np.concatenate([[0], np.cumsum(sizes[right])])[:-1]
        mark = np.zeros(int(flat.max()) + 1, np.int32)
        found = []
        for i in np.flatnonzero(side != 1) if len(right) else ():
            own = flat[offsets[i] : offsets[i + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[places], begins)
            mark[own] = 0
            for j in right[(root[right] != root[i]) & (100 * common >= per_cent * (sizes[i] + sizes[right] - common))]:
                x, y = find(root[i]), find(root[j])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    found.append((rid[i], rid[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _block_links(big: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, plan: Plan) -> DataFrame:
    """Links between components inside large buckets, compared exactly in blocks of about ``SIDE`` shingles.

    Large buckets that share documents form a group. A component of many shingles in a group gets blocks of its own, the
    other sets are pooled; every two blocks meet in a task of their own unless they hold the same component.
    """
    spark = docs.sparkSession
    groups = components(big.select(F.col("hub").alias("a"), F.col("rid").alias("b")))
    own = groups.select(F.col("id").alias("rid"), F.col("root").alias("g"))
    own = own.unionAll(groups.select(F.col("root").alias("rid"), F.col("root").alias("g"))).distinct()
    rows = materialise(big.select("rid", "root").distinct().join(own, "rid").join(classes.select("rid", "size"), "rid"), "crowd")
    limit = hot_limit(rows.count(), spark)
    count = materialise(rows.groupBy("g", "root").agg(F.sum("size").alias("m"), F.count(F.lit(1)).alias("n")), "count")
    owners = count.withColumn("owner", F.when(F.col("m") >= SIDE // 2, F.col("root"))).withColumn("m", F.when(F.col("owner").isNotNull(), F.col("m")))
    placed = join_counted(rows, owners, ["g", "root"], F.col("rid"), "n", limit).select("g", "rid", "root", "owner", "m")
    pooled = count.groupBy("g").agg(F.coalesce(F.sum(F.when(F.col("m") < SIDE // 2, F.col("m"))), F.lit(0)).alias("pool"), F.sum("n").alias("n"))
    placed = join_counted(placed, pooled, ["g"], F.col("rid"), "n", limit)
    blocks_of = F.greatest(F.lit(1), F.ceil(F.coalesce("m", "pool") / F.lit(SIDE))).cast("long")
    placed = placed.withColumn("block", F.struct(F.coalesce("owner", F.lit(-1).cast("long")).alias("o"), F.pmod(F.xxhash64("rid"), blocks_of).alias("k"), F.col("owner").isNull().alias("p")))
    placed = materialise(placed.select("g", "rid", "root", "block"), "placed")
    every = placed.select("g", "block").distinct()
    x, y = every.select("g", F.col("block").alias("x")), every.select(F.col("g").alias("h"), F.col("block").alias("y"))
    units = x.join(y, (F.col("g") == F.col("h")) & (F.col("x") <= F.col("y")) & ((F.col("x.o") != F.col("y.o")) | F.col("x.p") & F.col("y.p"))).drop("h")
    unit = F.struct("g", "x", "y").alias("unit")
    same = F.col("x") == F.col("y")
    ends = units.select(unit, "g", F.explode(F.when(same, F.array(F.struct(F.lit(2).alias("side"), F.col("x").alias("block")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("block")), F.struct(F.lit(1).alias("side"), F.col("y").alias("block"))))).alias("e"))
    ends = ends.select("unit", "g", "e.side", "e.block")
    dealt = ends.join(placed, ["g", "block"]).select("unit", "side", "rid", "root")
    sets = materialise(shingle_arrays(docs, id_col, text_col, placed.select("rid").distinct(), plan), "sets")
    links = materialise(dealt.join(sets, "rid").groupBy("unit").applyInPandas(_compare_blocks(plan.per_cent), "a long, b long"), "links")
    for used in (groups, rows, count, placed, sets):
        drop(spark, used)
    return links


def near_duplicates(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Texts are lower-cased (A-Z), split into words at white space and reduced to their distinct ``plan.n``-word
    shingles; a text with fewer words is one shingle. Two documents are linked if their sets' Jaccard similarity is at
    least ``plan.per_cent`` / 100. ``component_id`` is the smallest id reachable over links; ``kept``: it is the row's own.

    Equal sets become one class first, so copies cost one row each. Class signatures are joined by the multi-index
    of ``Plan``. In each bucket every class is compared with the bucket's smallest id only; links of those stars form
    components. Pairs in one component need no comparison any more; pairs of different components that share a bucket
    are compared one by one in small buckets and by blocks in large ones. All links are confirmed on whole sets.

    Defined cases: null or wordless texts have no shingles and are linked with nothing. A null id is in no component
    (component_id null) and is kept. Rows that repeat an id are one document with several texts: it is linked with
    whatever one of its texts is linked with, and each row is returned. Other columns are ignored. No rows: no rows.
    """
    return _labelled(docs, plan, id_col, text_col)[0]


def _labelled(docs: DataFrame, plan: Plan, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """The result of ``near_duplicates``, and the tables that it reads, to be deleted once it is written."""
    spark = docs.sparkSession
    base = materialise(signatures(docs, id_col, text_col, plan).withColumn("row", F.monotonically_increasing_id()), "signatures")
    some = base.where("set_hash is not null and doc_id is not null")
    classes = materialise(some.groupBy("set_hash").agg(F.min("doc_id").alias("rid"), F.min("sig").alias("sig"), F.min("probe").alias("probe"), F.max("n_shingles").alias("size"), F.count(F.lit(1)).alias("copies")), "classes")
    keys = index_keys(classes, plan)
    limit = hot_limit((classes.agg(F.sum(F.octet_length("sig"))).first()[0] or 0) // 8 * (1 if plan.exact else WIDTH), spark)
    shared = materialise(keys.groupBy("key").agg(F.min("rid").alias("hub"), F.max("rid").alias("hi"), F.count(F.lit(1)).alias("n")).where("hub < hi"), "shared")
    crowds = shared.where("n > 2").select("key", "hub", "n")
    members = materialise(join_counted(keys, crowds, ["key"], F.col("rid"), "n", limit).select("key", "rid", "hub", "n"), "members")
    stars = shared.where("n = 2").select(F.col("hub").alias("a"), F.col("hi").alias("b")).unionAll(members.where("rid <> hub").select(F.col("hub").alias("a"), F.col("rid").alias("b")))
    links = _links(materialise(stars.distinct(), "stars"), classes, docs, id_col, text_col, plan)
    roots = components(links)
    drop(spark, links)

    own = materialise(members.join(roots.withColumnRenamed("id", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid")), "own")
    tops = own.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("up"), F.max("n").alias("n")).where("lo < up").select("key", "n")
    mixed = materialise(join_counted(own.drop("n"), tops, ["key"], F.col("rid"), "n", limit).select("key", "rid", "hub", "root", "n"), "mixed")
    small = mixed.where((F.col("n") <= SMALL) & (F.col("rid") != F.col("hub"))).select("key", "rid", "root")
    x, y = small.select("key", F.col("rid").alias("a"), F.col("root").alias("ra")), small.select("key", F.col("rid").alias("b"), F.col("root").alias("rb"))
    crossing = materialise(x.join(y, "key").where("a < b and ra <> rb").select("a", "b").distinct(), "crossing")
    more = [_links(crossing, classes, docs, id_col, text_col, plan)]
    big = materialise(mixed.where(F.col("n") > SMALL).select("hub", "rid", "root").distinct(), "big")
    if not big.isEmpty():
        more.append(_block_links(big, classes.groupBy("rid").agg(F.max("size").alias("size")), docs, id_col, text_col, plan))
    twice = some.groupBy("doc_id").agg(F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("doc_id", "n")
    total = hot_limit(base.count(), spark)
    texts = join_counted(some.select("doc_id", "set_hash", "row"), twice, ["doc_id"], F.col("row"), "n", total).select("doc_id", "set_hash", "row")
    texts = join_counted(texts, classes.select("set_hash", "rid", "copies"), ["set_hash"], F.col("row"), "copies", total)
    more.append(texts.select(F.col("doc_id").alias("a"), F.col("rid").alias("b")).where("a <> b").distinct())
    rest = more[0]
    for part in more[1:]:
        rest = rest.unionAll(part)
    rest = materialise(rest, "links")
    if not rest.isEmpty():
        first, roots = roots, components(rest.unionAll(roots.select(F.col("id").alias("a"), F.col("root").alias("b"))))
        drop(spark, first)
    for used in (shared, members, own, mixed, crossing, big, rest, *more[:-1]):
        drop(spark, used)
    labels = classes.join(roots.select(F.col("id").alias("rid"), "root"), "rid", "left").where("copies > 1 or root is not null")
    labels = labels.select("set_hash", F.coalesce("root", "rid").alias("root"), "copies")
    done = join_counted(some, labels, ["set_hash"], F.col("row"), "copies", total, "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    rest = base.where("set_hash is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return done.unionAll(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), [base, classes, roots]


def keep_one(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component: one for each, and every row with a null id.

    Of rows that repeat the id of a kept document one stays: the least by the hash of its columns (maps left out; rows that differ only in
    those are taken as equal). Columns may have any names and types. No rows: no rows.
    """
    spark = docs.sparkSession
    labelled, used = _labelled(docs, plan, id_col, text_col)
    found = materialise(labelled.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n")), "kept")
    for table in used:
        drop(spark, table)
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(*hashed).alias("hash"), F.monotonically_increasing_id().alias("place"))
    rows = rows.where("id is not null")
    if found.count() <= BROADCAST_IDS:  # and whole rows stay where they are
        chosen = rows.join(F.broadcast(found), "id")
    else:
        chosen = join_counted(rows, found, ["id"], F.col("place"), "n", hot_limit(docs.count(), spark))
    if found.where("n > 1").isEmpty():
        once = chosen.select("row.*")
    else:
        first = chosen.where("n > 1").groupBy("id").agg(F.min_by("row", "hash").alias("row"))
        once = chosen.where("n = 1").select("row.*").unionAll(first.select("row.*"))
    return once.unionAll(docs.where(F.col(id_col).cast("long").isNull()))
