"""Words, word hashes and shingles of many texts at once, on bytes.

Words are maximal runs of bytes other than space and TAB..CR, so UTF-8 needs no decoding. The number of a word of up to 7 bytes is those bytes and
their count, mixed one to one; that of a longer one is 64 bits of its BLAKE2b digest. So short words never share a number, and no
family of long ones is known to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64
#: Bytes of a word that its number holds itself.
SHORT = 7

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Block(NamedTuple):
    """Some whole texts. ``rows``: their places in the batch; ``offsets``: bytes before each; ``first``: words before each."""

    rows: range
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the offsets of each; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    flat = texts.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = flat.buffers()
    if len(flat) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), o


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    """Whole texts, about ``size`` bytes at a time; a longer text is a block of its own."""
    data, offsets = as_bytes(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n)
        part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        yield find_words(range(lo, hi), part, own)
        lo = hi


def find_words(rows: range, data: np.ndarray, offsets: np.ndarray) -> Block:
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, word[:-1]
        after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return Block(rows, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def _long_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Digests of words of more than ``SHORT`` bytes, each different one made once."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1  # a word may begin where one of the text before ends
    flat = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]).dictionary_encode()
    own = b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in words.dictionary.to_pylist())
    return np.frombuffer(own, _U)[words.indices.to_numpy(zero_copy_only=False)]


def word_hashes(block: Block, lower: bool = False) -> np.ndarray:
    """A 64-bit number for each word of the block, which does not depend on where the word stands.

    Long texts are taken in pieces of about ``BLOCK`` bytes that end with a word; a longer word is a piece of its own.
    """
    out = np.empty(len(block.starts), _U)
    at = 0
    while at < len(out):
        low = int(block.starts[at])
        to = max(at + 1, int(np.searchsorted(block.ends, low + BLOCK, "right")))
        starts, ends = block.starts[at:to] - low, block.ends[at:to] - low
        data = block.data[low : low + int(ends[-1])]
        data = LOWER[data] if lower else data
        lengths = ends - starts
        long = lengths > SHORT
        padded = np.concatenate([data, np.zeros(SHORT, np.uint8)])
        packed = lengths.astype(_U) << _U(56)
        for k in range(SHORT):
            packed |= np.where(lengths > k, padded[starts + k], 0).astype(_U) << _U(8 * k)
        own = mix(packed)
        if long.any():
            own[long] = _long_words(data, starts[long], ends[long])
        out[at:to] = own
        at = to
    return out


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, by its first word."""
    if len(words) < n:
        return np.zeros(0, _U)
    total = np.zeros(len(words) - n + 1, _U)
    for k in range(n):
        total = total * _U(0x9FB21C651E98DF25) + words[k : k + len(total)]
    return mix(total + _U(n))


def shingle_sets(block: Block, n: int, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its n-word shingles). Fewer words: the whole sequence; no words: empty."""
    words = word_hashes(block, lower)
    runs = window_hashes(words, n)
    first = block.first
    for i, row in enumerate(block.rows):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= n:
            yield row, np.unique(runs[a : b - n + 1])
        elif b > a:
            yield row, window_hashes(words[a:b], b - a)
        else:
            yield row, np.zeros(0, _U)
