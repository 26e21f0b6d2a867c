"""Language identification: interpolated Kneser-Ney character models, one for each language, in sorted hash arrays."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import hot_limit, join_counted
from ..storage import drop, materialise
from .words import mix

_U = np.uint64
#: Symbols of a gram, bits of a symbol, and symbols in the alphabet over which the last order is even.
ORDER, BITS = 4, 16
ALPHABET = 1 << BITS
#: Grams of all languages and orders together that a ``Model`` may hold: a bound of what is broadcast (16 bytes each, histories included at most 32). Where there are more, ``Tables`` hold them all.
CAPACITY = 2_000_000
#: Code points that are handled at once, and grams that a task holds back before it gives out counts.
BLOCK, HELD = 1 << 20, 1_000_000
#: Steps of evidence in the calibration of scores, width of a step of cross-entropy, share of right texts that rejection keeps.
STEPS, WIDTH, KEEP = 64, 0.05, 0.999
UNKNOWN = "und"


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its symbol (its lower-case form, 0 for all but letters and marks), and whether it is a letter.

    A letter outside the first plane becomes the first half of its UTF-16 form, so a symbol has 16 bits and a gram is one exact 64-bit number.
    """
    symbols, letters = np.zeros(0x110000, np.uint16), np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        kind = unicodedata.category(c)[0]
        if kind in "LM":
            low = c.lower()
            k = ord(low) if len(low) == 1 else i
            symbols[i] = k if k < 0x10000 else 0xD800 + ((k - 0x10000) >> 10)
            letters[i] = kind == "L"
    return symbols, letters


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _grams(s: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Each symbol with the three before it; before the first symbol of a text there are zeros."""
    wide = s.astype(_U)
    out = wide.copy()
    at = np.zeros(len(s) + 1, bool)
    at[begins] = True
    first = at[: len(s)]
    for k in range(1, ORDER):
        before = np.zeros(len(s), _U)
        before[k:] = wide[:-k]
        if k > 1:  # the last symbol of the text before is 0 as well
            near = first.copy()
            for j in range(1, k - 1):
                near[j:] |= first[:-j]
            before[near] = 0
        out |= before << _U(BITS * k)
    return out


def gram_blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[int], np.ndarray, list[bool]]]:
    """(grams, rows, grams of each row, whether a letter was seen): a bounded block at a time; a long text comes in several, its grams are those of the whole.

    A text's symbols are its letters and marks in lower case; each run of others between or after them is one 0.
    """
    symbols, letters = _tables()
    group: list[int] = []
    size = 0
    for i in [*range(len(texts)), None]:
        text = None if i is None else texts[i]
        if group and (i is None or size + len(text or "") > BLOCK):
            lengths = np.array([len(texts[k]) + 1 for k in group])
            points = _points("\n".join(texts[k] for k in group) + "\n")
            s = symbols[points]
            keep = s != 0
            keep[1:] |= s[:-1] != 0
            edges = np.concatenate([[0], np.cumsum(lengths)])
            kept = np.concatenate([[0], np.cumsum(keep)])[edges]
            seen = np.concatenate([[0], np.cumsum(letters[points])])[edges]
            yield _grams(s[keep], kept[:-1]), group, np.diff(kept), (np.diff(seen) > 0).tolist()
            group, size = [], 0
        if text and len(text) > BLOCK:
            carry, found = np.zeros(0, np.uint16), False
            for at in range(0, len(text), BLOCK):
                points = _points(text[at : at + BLOCK] + ("\n" if at + BLOCK >= len(text) else ""))
                s = symbols[points]
                keep = s != 0
                keep[1:] |= s[:-1] != 0
                keep[0] |= bool(len(carry) and carry[-1])
                s = np.concatenate([carry, s[keep]])
                found = found or bool(letters[points].any())
                grams = _grams(s, np.array([0]))[len(carry) :]
                yield grams, [i], np.array([len(grams)]), [found]
                carry = s[-(ORDER - 1) :]
        elif text:
            group.append(i)
            size += len(text) + 1


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, own = pd.factorize(keys)
    return own, np.bincount(codes, weights=counts, minlength=len(own)).astype(np.int64)


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, fit, rest): how often each gram is in the texts of each language, apart for rows (text, lang, part) of parts 0 and 1, and 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool], list] = {}
        size = 0

        def give() -> Iterator[pa.RecordBatch]:
            for (lang, rest), parts in held.items():
                own, n = _counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                zero = np.zeros(len(own), np.int64)
                columns = [pa.array([lang]).take(pa.array(zero)), pa.array(own.view(np.int64)), pa.array(zero if rest else n), pa.array(n if rest else zero)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "fit", "rest"])
            held.clear()

        for batch in batches:
            langs = batch.column(1).to_pylist()
            parts = batch.column(2).to_pylist()
            kinds: dict[tuple[str, bool], int] = {}
            kind = np.array([kinds.setdefault((x, p == 3), len(kinds)) for x, p in zip(langs, parts)], int)
            for grams, group, sizes, _ in gram_blocks(batch.column(0).to_pylist()):
                own = np.repeat(kind[group], sizes)
                for key in set(kind[group].tolist()):
                    mine = grams if len(kinds) == 1 else grams[own == key]
                    found = _counted(mine, np.ones(len(mine)))
                    held.setdefault(list(kinds)[key], []).append(found)
                    size += len(found[0])
            if size > HELD:
                for name, pieces in held.items():
                    held[name] = [_counted(np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]))]
                size = sum(len(p[0][0]) for p in held.values())
                if size > HELD // 2:
                    yield from give()
                    size = 0
        yield from give()

    return rows.mapInArrow(run, "lang string, gram long, fit long, rest long").groupBy("lang", "gram").agg(F.sum("fit").alias("fit"), F.sum("rest").alias("rest"))


class Order(NamedTuple):
    """One order of one language: hashes of grams, sorted, with the logarithm of their probability; hashes of histories with that of what is left for lower orders."""

    grams: np.ndarray
    log_p: np.ndarray
    histories: np.ndarray
    log_rest: np.ndarray


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, whether found) of hashes in a sorted table."""
    at = np.minimum(np.searchsorted(table, wanted), max(len(table) - 1, 0))
    return at, table[at] == wanted if len(table) else np.zeros(len(wanted), bool)


class Model(NamedTuple):
    """``orders[lang]``: orders 1 to ORDER. Any symbol has a positive probability after any history."""

    langs: list[str]
    orders: list[list[Order]]

    def log_p(self, lang: int, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """ln p(last symbol | the ones before it) of each gram of ``order`` symbols."""
        out, todo, grams = np.zeros(len(grams)), np.arange(len(grams)), grams.astype(_U)
        for k in range(order, 0, -1):
            own = self.orders[lang][k - 1]
            at, found = _find(own.grams, mix(grams))
            out[todo[found]] += own.log_p[at[found]]
            todo, grams = todo[~found], grams[~found]
            if not len(todo):
                break
            at, found = _find(own.histories, mix(grams >> _U(BITS)))
            out[todo[found]] += own.log_rest[at[found]]
            grams = grams & _U((1 << BITS * (k - 1)) - 1)
        else:
            out[todo] -= np.log(ALPHABET)
        return out


def _least(counted: DataFrame, most: int) -> int:
    """The least power of 2 such that at most ``most`` rows have a count ``c`` of it or more."""
    seen = 0
    for r in counted.groupBy(F.floor(F.log2("c")).cast("int").alias("p")).count().orderBy(F.desc("p")).collect():
        seen += r["count"]
        if seen > most:
            return 1 << (r["p"] + 1)
    return 1


def _kept(grams: DataFrame, capacity: int | None) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, k, gram, share, rest) of the grams (lang, gram, n) that the model holds, and tables to delete.

    The highest order counts occurrences, each lower one the different symbols before a gram. One discount for a language and order, n1 / (n1 + 2 n2),
    is within 0.1 and 0.9. ``share``: the discounted count over its history's total; ``rest``: what the history leaves for lower orders, all that
    grams left out would have had included. Each order may have a fourth of ``capacity``: grams counted under the least power of 2 that brings it there are left out; none if it is None.
    """
    tables, out, level = [], None, grams.select("lang", "gram", F.col("n").alias("c"))
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            level = level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        level = materialise(level, f"order{k}")
        tables.append(level)
        least = 1 if capacity is None else _least(level, capacity // ORDER)
        ones = level.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
        cut = F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))))
        own = Window.partitionBy("lang", "history")
        held = F.col("c") >= least
        rows = level.join(F.broadcast(ones.select("lang", cut.alias("d"))), "lang")  # a row for each language
        rows = rows.withColumn("history", F.shiftrightunsigned("gram", BITS)).select("lang", "gram", "history", "c", "d", F.sum("c").over(own).alias("total"), F.sum(F.when(held, F.col("c"))).over(own).alias("sum"), F.count_if(held).over(own).alias("m"))
        share, rest = (F.col("c") - F.col("d")) / F.col("total"), 1 - (F.col("sum") - F.col("d") * F.col("m")) / F.col("total")
        rows = rows.where(held).select("lang", F.lit(k).alias("k"), "gram", share.alias("share"), rest.alias("rest"))
        out = rows if out is None else out.unionAll(rows)
    return out, tables


def build(grams: DataFrame, capacity: int = CAPACITY) -> Model:
    """The model of counted grams (lang, gram, n): at most ``capacity`` grams, whatever the corpus, are sent to the driver."""
    rows, tables = _kept(grams, capacity)
    found = rows.toArrow()
    for table in tables:
        drop(grams.sparkSession, table)
    order, gram, share, rest = (found[c].to_numpy() for c in ("k", "gram", "share", "rest"))
    code, names = pd.factorize(found["lang"].to_numpy(zero_copy_only=False), sort=True)
    model = Model(list(names), [[] for _ in names])
    for lang in range(len(names)):
        mine = np.flatnonzero(code == lang)
        for k in range(1, ORDER + 1):
            at = mine[order[mine] == k]
            own = gram[at].view(_U)
            lower = np.exp(model.log_p(lang, own & _U((1 << BITS * (k - 1)) - 1), k - 1))
            p = share[at] + rest[at] * lower
            keys = mix(own)
            sort = np.argsort(keys)
            histories, first = np.unique(mix(own >> _U(BITS)), return_index=True)
            model.orders[lang].append(Order(keys[sort], np.log(p)[sort], histories, np.log(rest[at][first])))
    return model


class Tables(NamedTuple):
    """A model of any number of grams, none left out: a table of each order, so that no process holds more than its share.

    ``grams[k - 1]``: (gram, found), ``histories[k - 1]``: (history, left), with maps from places in ``langs`` to ln p and to the logarithm of what is left for lower orders.
    ``keys``, sorted: the grams of ORDER symbols that are counted most, and ``head`` their ln p in each language; these are decided where the texts are.
    """

    langs: list[str]
    grams: list[DataFrame]
    histories: list[DataFrame]
    keys: np.ndarray
    head: np.ndarray

    def log_p(self, wanted: DataFrame, order: int = ORDER) -> DataFrame:
        """(gram, log_p: its ln p in each language) of different grams of ``order`` symbols: what ``Model.log_p`` gives.

        Joined an order at a time, so a key has at most as many rows as there are symbols.
        """
        rows = wanted.join(self.grams[order - 1], "gram", "left").withColumn("history", F.shiftrightunsigned("gram", BITS)).join(self.histories[order - 1], "history", "left")
        lower = lambda k: F.lit(-float(np.log(ALPHABET)))
        if order > 1:
            short = F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))
            below = self.log_p(wanted.select(short.alias("gram")).distinct(), order - 1)
            rows = rows.withColumn("short", short).join(below.select(F.col("gram").alias("short"), F.col("log_p").alias("below")), "short")
            lower = lambda k: F.get("below", k)
        each = F.transform(F.sequence(F.lit(0), F.lit(len(self.langs) - 1)), lambda k: F.coalesce(F.element_at("found", k), F.coalesce(F.element_at("left", k), F.lit(0.0)) + lower(k)))
        return rows.select("gram", each.alias("log_p"))

    def drop(self) -> None:
        for table in (*self.grams, *self.histories):
            drop(table.sparkSession, table)


def build_tables(grams: DataFrame, capacity: int = CAPACITY) -> Tables:
    """The model of counted grams (lang, gram, n) as tables; at most ``capacity`` numbers, those of its head, are sent to the driver."""
    spark = grams.sparkSession
    rows, used = _kept(grams, None)
    langs = sorted(r.lang for r in grams.select("lang").distinct().collect())
    place = (F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1).cast("int")
    each = lambda value, name: F.map_from_entries(F.collect_list(F.struct(place, value))).alias(name)
    by_gram, by_history, below = [], [], None
    for k in range(1, ORDER + 1):
        own, lower = rows.where(F.col("k") == k), F.lit(1.0 / ALPHABET)
        if k > 1:  # each gram without its first symbol is one of the order below
            own = own.withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))).join(below.select("lang", F.col("gram").alias("short"), F.col("p").alias("lower")), ["lang", "short"])
            lower = F.col("lower")
        below = materialise(own.select("lang", "gram", "rest", (F.col("share") + F.col("rest") * lower).alias("p")), f"p{k}")
        used.append(below)
        left = below.groupBy("lang", F.shiftrightunsigned("gram", BITS).alias("history")).agg(F.first("rest").alias("rest"))  # the same for all grams of a history
        by_gram.append(materialise(below.groupBy("gram").agg(each(F.ln("p"), "found")), f"found{k}"))
        by_history.append(materialise(left.groupBy("history").agg(each(F.ln("rest"), "left")), f"left{k}"))
    counted = materialise(grams.groupBy("gram").agg(F.sum("n").alias("c")), "counted")
    used.append(counted)
    out = Tables(langs, by_gram, by_history, np.zeros(0, np.int64), np.zeros((0, len(langs))))
    found = out.log_p(counted.where(F.col("c") >= _least(counted, capacity // len(langs))).select("gram")).toArrow().combine_chunks()
    for table in used:
        drop(spark, table)
    keys = found["gram"].to_numpy()
    head = found["log_p"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(keys), len(langs)) if len(keys) else out.head
    sort = np.argsort(keys.view(_U))
    return out._replace(keys=keys.view(_U)[sort], head=head[sort])


def learn(grams: DataFrame, capacity: int = CAPACITY) -> Model | Tables:
    """The whole model of counted grams (lang, gram, n): in memory if it holds at most ``capacity`` grams, else as tables."""
    few = grams.count() <= capacity // ORDER  # a lower order has no more of them
    return build(grams, capacity) if few else build_tables(grams, capacity)


def _score_tables(rows: DataFrame, model: Tables, columns: tuple[str, ...]) -> DataFrame:
    """``score`` by tables: grams of the head are summed with the texts; the others of each text, with their counts, meet their ln p in a join."""
    spark, n = rows.sparkSession, len(model.langs)
    sent = spark.sparkContext.broadcast((model.keys, model.head))
    kept = rows.select("text", *columns)
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in kept.dtypes[1:]), "total array<double>, symbols long, seen boolean, tail array<bigint>, times array<bigint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, head = sent.value
        for batch in batches:
            total, size, seen = np.zeros((len(batch), n)), np.zeros(len(batch), np.int64), np.zeros(len(batch), bool)
            tails: list[list[np.ndarray]] = [[] for _ in range(len(batch))]
            for grams, group, sizes, lettered in gram_blocks(batch.column(0).to_pylist()):
                seen[group] |= np.array(lettered, bool)
                size[group] += sizes
                at, found = _find(keys, grams)
                full = np.flatnonzero(sizes)
                ends = np.cumsum(sizes)
                for k in range(n if len(full) else 0):
                    known = np.zeros(len(grams))
                    known[found] = head[at[found], k]
                    total[np.array(group)[full], k] += np.add.reduceat(known, (ends - sizes)[full])
                for k in full:
                    own = slice(ends[k] - sizes[k], ends[k])
                    tails[group[k]].append(_counted(grams[own][~found[own]], np.ones(int((~found[own]).sum()))))
            merged = [_counted(np.concatenate([x[0] for x in t]), np.concatenate([x[1] for x in t])) if t else (np.zeros(0, _U), np.zeros(0, np.int64)) for t in tails]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in merged])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[k] for x in merged]).view(np.int64))) for k in (0, 1)] if merged else [pa.array([], pa.list_(pa.int64()))] * 2
            totals = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * n), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], totals, pa.array(size), pa.array(seen), *lists], [*batch.schema.names[1:], "total", "symbols", "seen", "tail", "times"])

    first = materialise(kept.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()), "scored")
    tail = first.select("__row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("__row", F.col("t.tail").alias("gram"), F.col("t.times").alias("times"))
    wanted = materialise(tail.groupBy("gram").agg(F.count(F.lit(1)).alias("texts")), "wanted")
    worth = materialise(wanted.join(model.log_p(wanted.select("gram")), "gram"), "worth")
    met = join_counted(tail, worth, ["gram"], F.col("__row"), "texts", hot_limit(wanted.agg(F.sum("texts")).first()[0] or 0, spark))
    one = lambda k: F.sum(F.col("log_p")[k].cast("decimal(18,12)") * F.col("times").cast("decimal(15,0)")).cast("double")  # noqa: E731  (in any order the same)
    sums = met.groupBy("__row").agg(F.array(*[one(k) for k in range(n)]).alias("more"))
    entropy = lambda k: -(F.get("total", k) + F.coalesce(F.get("more", k), F.lit(0.0))) / F.greatest("symbols", F.lit(1))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(entropy(k).alias("e"), k.alias("at"))))
    both = first.join(sums, "__row", "left").withColumn("order", F.when(F.col("seen") & (F.col("symbols") > 0), order))
    margin = F.col("order")[1]["e"] - F.col("order")[0]["e"] if n > 1 else F.when(F.col("order").isNotNull(), F.lit(float("inf")))
    out = materialise(both.select(*columns, F.col("order")[0]["at"].alias("best"), F.col("order")[0]["e"].alias("entropy"), margin.alias("margin"), "symbols"), "entropies")
    for table in (first, wanted, worth):
        drop(spark, table)
    return out


def score(rows: DataFrame, model: Model | Tables, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of rows (text, ...) with best (its place in ``model.langs``), entropy, margin, symbols.

    ``entropy``: the lowest cross-entropy of the text, in nats a symbol; ``margin``: how much higher that of the next language is, infinite if there is none. ``best`` is
    null if the text is null or has no letter. Ties go to the language that sorts first.
    """
    if isinstance(model, Tables):
        return _score_tables(rows, model, columns)
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kept = rows.select("text", *columns)
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in kept.dtypes[1:]), "best int, entropy double, margin double, symbols long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            total, n, seen = np.zeros((len(batch), len(own.langs))), np.zeros(len(batch), np.int64), np.zeros(len(batch), bool)
            for grams, group, sizes, lettered in gram_blocks(batch.column(0).to_pylist()):
                seen[group] |= np.array(lettered, bool)
                n[group] += sizes
                codes, different = pd.factorize(grams)
                full = np.flatnonzero(sizes)
                begins = (np.cumsum(sizes) - sizes)[full]
                for k in range(len(own.langs) if len(full) else 0):
                    total[np.array(group)[full], k] -= np.add.reduceat(own.log_p(k, different)[codes], begins)
            good = seen & (n > 0) & bool(own.langs)
            mean = total / np.maximum(n, 1)[:, None]
            order = np.argsort(mean, axis=1, kind="stable")[:, :2]
            best = mean[np.arange(len(mean)), order[:, 0]] if own.langs else n * 0.0
            margin = mean[np.arange(len(mean)), order[:, 1]] - best if len(own.langs) > 1 else np.full(len(mean), np.inf)
            first = order[:, 0] if own.langs else n
            columns = [pa.array(first.astype(np.int32), mask=~good), pa.array(best, mask=~good), pa.array(margin, mask=~good), pa.array(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], "best", "entropy", "margin", "symbols"])

    return kept.mapInArrow(run, schema)


def _evidence() -> Column:
    """The step of a text's evidence: the logarithm of how much likelier the best language makes it than the next."""
    return F.least(F.lit(STEPS - 1), F.floor(4 * F.log2(1 + F.col("margin") * F.col("symbols")))).cast("int")


def _length() -> Column:
    return F.floor(F.log2(F.greatest("symbols", F.lit(1)))).cast("int")


def _calibrate(scored: DataFrame, langs: list[str]) -> tuple[list[float], DataFrame]:
    """The score of each step of evidence, and (best, length, limit): cross-entropies over the limit are rejected.

    ``scored`` are texts of known language that the model has not seen. A score is the share of right ones in its step, one of each kind added, made to rise with the evidence by
    pooling. A limit is where ``KEEP`` of the right texts of that language and length (a power of 2) have been passed.
    """
    right = F.col("lang") == F.element_at(F.array(*[F.lit(x) for x in langs]), F.col("best") + 1)
    counts = {r.step: (r.n, r.good) for r in scored.groupBy(_evidence().alias("step")).agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("good")).collect()}
    pools: list[list[float]] = []
    for step in range(STEPS):
        n, good = counts.get(step, (0, 0))
        pools.append([good + (1 if n else 0.5 * step / STEPS + 0.5), n + (2 if n else 1), 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    scores = [good / n for good, n, width in pools for _ in range(int(width))]
    bins = scored.where(right).groupBy("best", _length().alias("length"), F.floor(F.col("entropy") / WIDTH).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("best", "length")
    passed = bins.select("best", "length", "bin", F.sum("n").over(own).alias("all"), F.sum("n").over(own.orderBy("bin")).alias("so_far"))
    return scores, passed.where(F.col("so_far") >= KEEP * F.col("all")).groupBy("best", "length").agg((WIDTH * (1 + F.min("bin"))).alias("limit"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected, entropy, margin) of each row's whole text.

    Rows fall into four parts by crc32 of the id's decimal text. Part 2 is held out; part 3 calibrates a model of parts 0 and 1; the model that predicts is
    of parts 0, 1 and 3. Models hold every gram of every text of these parts; ``capacity`` decides only whether in memory or as tables (``learn``). ``lang_pred`` is the
    language with the lowest cross-entropy a symbol; ``score`` the share of right predictions among calibration texts of like evidence; ``rejected``
    says that the text fits even that language worse than nearly all texts of its length do (``_calibrate``), so it is likely in none of the learned ones.

    Defined cases: null texts and texts without a letter, and all texts if no row has a language to learn, are ``und`` with score 0, not rejected. A row with a null language is predicted only;
    one with a null id is not held out and not learned from. Repeated rows count and are predicted each. Texts of any length are taken whole. Without calibration texts
    scores follow a fixed rise from 0.5. Other columns, whatever their names, are ignored. No rows: no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)).cast("int").alias("part"))
    learned = rows.where("lang is not null and text is not null and part <> 2")
    grams = materialise(count_grams(learned.select("text", "lang", "part")), "grams")
    trial = learn(grams.where("fit > 0").select("lang", "gram", F.col("fit").alias("n")), capacity)
    model = learn(grams.select("lang", "gram", (F.col("fit") + F.col("rest")).alias("n")), capacity)
    scores, limits = [0.5 + 0.5 * (k + 1) / (STEPS + 1) for k in range(STEPS)], None
    place = F.lit(None).cast("int")
    if trial.langs:
        seen = materialise(score(learned.where("part = 3"), trial, ("lang",)).where("best is not null"), "calibration")
        scores, limits = _calibrate(seen, trial.langs)
        same = {k: model.langs.index(x) for k, x in enumerate(trial.langs)}
        place = F.element_at(F.array(*[F.lit(same[k]) for k in range(len(trial.langs))]), F.col("best") + 1)
        limits = spark.createDataFrame(limits.select(place.alias("best"), "length", "limit").toArrow())
    drop(spark, grams)
    found = score(rows, model, ("doc_id", "part"))
    for used in (trial, model):
        if isinstance(used, Tables):
            used.drop()
    if limits is not None:  # at most a row for each language and power of 2
        found = found.withColumn("length", _length()).join(F.broadcast(limits), ["best", "length"], "left")
        found = found.join(F.broadcast(limits.groupBy("best").agg(F.max("limit").alias("most"))), "best", "left").withColumn("limit", F.coalesce("limit", "most"))
    else:
        found = found.withColumn("limit", F.lit(None).cast("double"))
    known = F.col("best").isNotNull()
    names = F.array(*[F.lit(x) for x in model.langs or [UNKNOWN]])
    value = F.element_at(F.array(*[F.lit(float(x)) for x in scores]), _evidence() + 1)
    return found.select(
        "doc_id",
        F.coalesce(F.col("part") == 2, F.lit(False)).alias("held_out"),
        F.when(known, F.element_at(names, F.col("best") + 1)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, value).otherwise(0.0).alias("score"),
        F.coalesce(F.col("entropy") > F.col("limit"), F.lit(False)).alias("rejected"),
        "entropy",
        "margin",
    )
