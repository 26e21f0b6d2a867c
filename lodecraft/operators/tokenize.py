"""Conversations as tokens: each message's span by the prefixes of the rendered conversation, and masks that train on assistant messages only."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the label of tokens that are not trained on.
IGNORED = -100
TRAINED = "assistant"
SCHEMA = "input_ids array<int>, labels array<int>, assistant_mask array<int>, spans array<struct<role:string,start:int,end:int>>, error string"


#: How a message is written. It ends with a mark and a single line feed, so that its tokens do not depend on what follows.
TEMPLATE = "<|{role}|>\n{content}<|end|>\n"


def render(role: str, content: str, template: str = TEMPLATE) -> str:
    return template.replace("{role}", role).replace("{content}", content)


@lru_cache(4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(4)
def longest_token(path: str) -> int:
    """Bytes of the longest token: a text of so many times n bytes has n tokens at least."""
    return max(len(t.encode()) for t in _tokenizer(path).get_vocab())


@lru_cache(4)
def _byte_level(path: str) -> re.Pattern | None:
    """The pattern of added tokens, if all else is cut by the byte-level pattern alone, whose matches look one character ahead and none back."""
    spec = json.loads(_tokenizer(path).to_str())
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
        return None
    return re.compile("|".join(re.escape(t) for t in sorted((t["content"] for t in added), key=len, reverse=True)) or r"(?!)")


def _cuts(path: str, text: str) -> list[int]:
    """Where a byte-level tokenizer begins a pre-token or an added token; none with another tokenizer."""
    added = _byte_level(path)
    if added is None:
        return []
    pre, out, at = _tokenizer(path).pre_tokenizer, [], 0
    for start, end in [*(m.span() for m in added.finditer(text)), (len(text), None)]:
        out += [at + s for _, (s, _) in pre.pre_tokenize_str(text[at:start])]
        if end is not None:
            out.append(start)
        at = end
    return out


def encode(path: str, messages: list[tuple[str, str]], max_length: int, template: str = TEMPLATE) -> tuple:
    """(ids, labels, mask, spans, error) of one conversation.

    The whole is encoded once. A message ends at a token's end if the conversation up to there has just these tokens. With a byte-level tokenizer only what follows the last
    cut before that end, and the white space that it is in, can be cut otherwise, so that rest alone is encoded again; other tokenizers encode the whole prefix. ``error``: ``prefix`` if
    some message does not end so (a template may let it), ``length`` beyond ``max_length`` tokens; nothing is cut, then there are no tokens.
    """
    tokenizer = _tokenizer(path)
    parts = [render(r, c, template) for r, c in messages]
    text = "".join(parts)
    whole = tokenizer.encode(text, add_special_tokens=False)
    ids, offsets = whole.ids, whole.offsets  # each access makes the whole list anew
    if len(ids) > max_length:
        return None, None, None, None, "length"
    cuts = _cuts(path, text)
    spans, labels, mask, at, end, cut = [], [], [], 0, 0, 0
    for (role, _), part in zip(messages, parts):
        end += len(part)
        start = at
        while at < len(ids) and offsets[at][0] < end:
            at += 1
        while cut < len(cuts) and cuts[cut] < end:
            cut += 1
        back = cut - 1
        while back > 0 and text[cuts[back] - 1 : cuts[back] + 1].isspace():  # what follows a run of white space decides where it is cut
            back -= 1
        low = cuts[back] if cut else 0
        own = ids[_first(offsets, low, at) : at]
        if at and offsets[at - 1][1] > end or tokenizer.encode(text[low:end], add_special_tokens=False).ids != own:
            return None, None, None, None, "prefix"
        trained = role == TRAINED
        labels += ids[start:at] if trained else [IGNORED] * (at - start)
        mask += [int(trained)] * (at - start)
        spans.append((role, start, at))
    return ids, labels, mask, spans, None


def _first(offsets: list, low: int, at: int) -> int:
    """The first of the tokens before ``at`` that begins at ``low`` or after."""
    while at and offsets[at - 1][0] >= low:
        at -= 1
    return at


def tokenize(messages: DataFrame, path: str, max_length: int, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, ``SCHEMA``): a row of each conversation, its messages in the order of turns (then role and text).

    ``assistant_mask`` is 1 for tokens of assistant messages, ``labels`` their ids and ``IGNORED`` elsewhere, ``spans`` the tokens of each message; see ``encode``. A conversation
    that must be too long by its bytes is told so without being gathered, so what is gathered is bounded by ``max_length`` tokens.
    Null texts are empty, null roles too; a null conversation id is one conversation. Other columns are ignored. No rows: no rows.
    """
    kind = dict(messages.dtypes)[conv_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), text.alias("text"))
    most = longest_token(path) * max_length
    sizes = rows.groupBy("conv").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count(F.lit(1)).alias("n"))
    over = sizes.where((F.col("bytes") > most) | (F.col("n") > most)).select(F.struct("conv").alias("own"), "conv")
    kept = rows.join(over.select("own"), F.struct("conv").eqNullSafe(F.col("own")), "left_anti")
    gathered = kept.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.list_(pa.int32())] * 3 + [pa.list_(pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32())])), pa.string()]
        for batch in batches:
            found = [encode(path, [(x["role"], x["text"]) for x in m], max_length, template) for m in batch.column(1).to_pylist()]
            columns = [list(c) for c in zip(*found)]
            columns[3] = [None if s is None else [{"role": r, "start": a, "end": b} for r, a, b in s] for s in columns[3]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["conv", "input_ids", "labels", "assistant_mask", "spans", "error"])

    done = gathered.mapInArrow(run, f"conv {kind}, {SCHEMA}")
    empty = [F.lit(None).cast(c.split(None, 1)[1]).alias(c.split(None, 1)[0]) for c in ("input_ids array<int>", "labels array<int>", "assistant_mask array<int>", "spans array<struct<role:string,start:int,end:int>>")]
    long = over.select("conv", *empty, F.lit("length").alias("error"))
    return done.unionByName(long).withColumnRenamed("conv", conv_col)
