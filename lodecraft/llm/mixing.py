"""Mixing sources to target weights: Pfair windows, earliest deadline first. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import group_ranks

BLOCK = 64


def weight_of(source: Column, weights: Mapping[str, int], default: int) -> Column:
    """The integer weight of a source."""
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(source == F.lit(name), F.lit(w)).otherwise(out)
    return out.cast("long")


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _runs(sources: DataFrame) -> DataFrame:
    """(r_weight, r_turn, lo, n, slot, period): who has the slots of one period, for ``sources`` (weight, ...) with one row each.

    Sources of equal weight have equal windows, so they are scheduled as one class whose turns take as many slots as it has members:
    a run gives the slots from ``slot`` on to turn ``r_turn`` of members lo <= i < lo + n. At each step the released turn with the earliest
    deadline (ties to the heavier class) goes on until it is used up or another is released, so there are at most two runs for each turn of
    each class: the work and the table grow with the distinct weights, not with the number of sources or slots.
    """
    per_weight = sources.groupBy("weight").agg(F.count(F.lit(1)).alias("n"))
    one = per_weight.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("weight").alias("w"), "n")), asc=False).alias("all"))

    def step(s: Column, _: Column) -> Column:
        def bid(x: Column, i: Column) -> Column:
            return _let(s["turns"][i]["t"], lambda t: F.when(t < x["w"], F.struct(F.ceil((t + 1) * s["d"] / x["w"]).alias("due"), i.alias("i"), F.floor(t * s["d"] / x["w"]).alias("release"))))

        def taken(bids: Column) -> Column:
            later = F.array_min(F.transform(F.filter(bids, lambda b: b["release"] > s["now"]), lambda b: b["release"]))
            return F.struct(F.array_min(F.filter(bids, lambda b: b["release"] <= s["now"]))["i"].alias("i"), later.alias("later"))

        def size(x: Column) -> Column:
            return _let(s["turns"][x["i"]], lambda y: F.struct(x["i"].alias("i"), y["t"].alias("t"), y["rest"].alias("rest"), F.least(y["rest"], x["later"] - s["now"]).alias("n")))

        def go(x: Column) -> Column:
            own = s["all"][x["i"]]
            after = F.when(x["rest"] == x["n"], F.struct((x["t"] + 1).alias("t"), own["n"].alias("rest"))).otherwise(F.struct(x["t"].alias("t"), (x["rest"] - x["n"]).alias("rest")))
            turns = F.transform(s["turns"], lambda y, k: F.when(k == x["i"], after).otherwise(y))
            run = F.struct(own["w"].alias("w"), x["t"].alias("turn"), (own["n"] - x["rest"]).alias("lo"), x["n"].alias("n"), s["now"].alias("slot"))
            return F.struct((s["now"] + x["n"]).alias("now"), s["d"].alias("d"), s["all"].alias("all"), turns.alias("turns"), F.concat(s["runs"], F.array(run)).alias("runs"))

        return F.when(s["now"] >= s["d"], s).otherwise(_let(_let(_let(F.transform(s["all"], bid), taken), size), go))

    zero = F.lit(0).cast("long")
    period = F.aggregate("all", zero, lambda a, x: a + x["w"] * x["n"])
    turns = F.transform("all", lambda x: F.struct(zero.alias("t"), x["n"].alias("rest")))
    begin = F.struct(zero.alias("now"), period.alias("d"), F.col("all"), turns.alias("turns"), F.array().cast("array<struct<w:bigint,turn:bigint,lo:bigint,n:bigint,slot:bigint>>").alias("runs"))
    steps = F.sequence(F.lit(1).cast("long"), F.aggregate("all", F.lit(1).cast("long"), lambda a, x: a + 2 * x["w"]))
    done = one.select(F.aggregate(steps, begin, step).alias("s")).select("s.d", F.explode("s.runs").alias("r"))
    return done.select(F.col("r.w").alias("r_weight"), F.col("r.turn").alias("r_turn"), "r.lo", "r.n", "r.slot", F.col("d").alias("period"))


def _members(sources: DataFrame, source: str) -> DataFrame:
    """``sources`` with ``i``: the number of each among those of its weight, from 0."""
    return group_ranks(sources, ["weight"], [F.col(source)], "i")


def schedule(sources: DataFrame, source: str = "source", weight: str = "weight") -> DataFrame:
    """(source, weight, period, slot, turn): who has each slot of one period; ``sources`` has one row a source.

    A period has as many slots as the weights' sum D. Turn j of a source of weight w is released at floor(j * D / w) and
    due at ceil((j + 1) * D / w); each slot goes to the released turn with the earliest deadline (ties to the heavier source, then in a fixed
    order). The load is exactly 1, so every turn is placed inside its window, and at each slot t a
    source has had within one turn of t * w / D. The number of sources has no limit; products of D and a weight must be under 2**53.
    """
    named = sources.select(F.col(source).alias("s"), F.col(weight).cast("long").alias("weight"))
    on = (F.col("weight") == F.col("r_weight")) & (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("lo") + F.col("n"))
    placed = _members(named, "s").join(F.broadcast(_runs(named)), on)
    return placed.select(F.col("s").alias(source), F.col("weight").alias(weight), "period", (F.col("slot") + F.col("i") - F.col("lo")).alias("slot"), F.col("r_turn").alias("turn"))


def _placed(docs: DataFrame, weights: Mapping[str, int], default: int, block: int, source_col: str, id_col: str) -> DataFrame:
    """(row struct of all columns of ``docs``, mix_block, mix_slot, mix_place)."""
    if min([default, *weights.values()]) < 1:
        raise ValueError("weights are positive integers")
    sources = docs.select(F.col(source_col).alias("s")).distinct().withColumn("weight", weight_of(F.col("s"), weights, default))
    hashed = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if "map<" not in kind])
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(source_col).alias("s"), F.col(id_col).alias("id"), hashed.alias("hash"))
    ranked = group_ranks(rows, ["s"], [F.col("id"), F.col("hash")], "rank", labels=_members(sources, "s"))
    ranked = ranked.withColumn("mix_block", F.floor(F.col("rank") / block).cast("long"))
    on = (F.col("weight") == F.col("r_weight")) & (F.col("mix_block") % F.col("weight") == F.col("r_turn")) & (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("lo") + F.col("n"))
    slot = (F.floor(F.col("mix_block") / F.col("weight")) * F.col("period") + F.col("slot") + F.col("i") - F.col("lo")).cast("long")
    return ranked.join(F.broadcast(_runs(sources)), on).select("row", "mix_block", slot.alias("mix_slot"), (F.col("rank") % block).cast("long").alias("mix_place"))


def mix(docs: DataFrame, weights: Mapping[str, int], default: int = 1, block: int = BLOCK, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with mix_block, mix_slot and mix_place: the training order is (mix_slot, mix_place).

    A source's rows, in a fixed pseudo-random order, form blocks of ``block`` rows. Block b of a source of
    weight w is turn b mod w of period b div w; ``schedule`` gives the turn's slot within its period. Until
    a source is used up, after any number of slots it has had within one block of its share w / D. Slots of used-up sources are
    left out, so the others go on in proportion to their weights. Each row appears exactly once: nothing is repeated
    or dropped.

    The schedule is broadcast as runs of equal turns, at most twice the sum of the distinct weights, which the arguments bound; the number of
    sources has no limit. Rows are numbered within their source by salted windows, so one source may hold most rows; their windows sort
    whole rows, so texts of any length spill rather than fail.

    Defined cases: a null source is a source of its own, of weight ``default``. Null ids and repeated rows are
    numbered like others. A weight must be positive. Columns of ``docs`` named like the three new ones are replaced. No rows: no rows.
    """
    own = ("mix_block", "mix_slot", "mix_place")
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in own]
    return _placed(docs, weights, default, block, source_col, id_col).select(*kept, *own)


def mix_in_order(docs: DataFrame, weights: Mapping[str, int], default: int = 1, block: int = BLOCK, source_col: str = "source", id_col: str = "doc_id", partitions: int = 1) -> DataFrame:
    """The rows of ``docs``, columns as they were, dealt by ranges of slots and sorted: written files, read by name, hold the training order of ``mix``.

    Null sources and ids, repeated rows, empty tables and very long texts are as in ``mix``; columns may have any names, those of ``mix`` included.
    """
    placed = _placed(docs, weights, default, block, source_col, id_col)
    return placed.repartitionByRange(partitions, "mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place").select("row.*")
