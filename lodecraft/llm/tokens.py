"""Byte-level BPE ids of many texts at once.

A text is cut into pre-tokens by array operations on its code points; each distinct pre-token is encoded once and
kept in a table of the worker, by its characters. The ids are those of the ``tokenizers`` library for the same file: a
file of another kind, and texts with special tokens or characters of unsettled classes, go to that library itself.
"""

from __future__ import annotations

import ctypes
import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .words import mix

_U = np.uint64
BLOCK = 1 << 20
#: Distinct pre-tokens that a worker keeps.
KEPT = 500_000
#: Characters of a pre-token that its place in the table is found by; all are compared.
LOOKED_AT = 24
LETTER, NUMBER, SPACE, OTHER, UNSURE = 0, 1, 2, 3, 9
# The white space of the byte-level pattern, and its contractions.
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SHORT, LONG = "stmd", ("re", "ve", "ll")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def give_back() -> None:
    """Return what this process no longer uses to the system: a worker shares the memory of its executor, which needs it in the stages that follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point; unassigned ones, on which Unicode versions differ, are unsure."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((UNSURE if (c := unicodedata.category(chr(i))) in ("Cn", "Cs") else kind.get(c[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE)] = SPACE
    return table


def cut(points: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The starts of the pre-tokens of texts that begin at ``begins``: contractions, and runs of letters, numbers or others with one blank before them."""
    n = len(points)
    edge = np.zeros(n + 1, bool)
    edge[begins] = True
    edge[n] = True
    white, blank = kinds == SPACE, points == 32
    start = edge[:n].copy()
    start[1:] |= (kinds[1:] != kinds[:-1]) & ~(blank[:-1] & ~white[1:] & ~edge[1:n])
    last = np.zeros(n, bool)  # of a run of white space, before something else
    last[:-1] = white[:-1] & ~white[1:] & ~edge[1:n]
    start |= last
    at = np.flatnonzero((points == 39) & start)
    if len(at):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        room = begins[np.searchsorted(begins, at, "right")] if len(begins) else at
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, [ord(c) for c in SHORT]) & (at + 1 < room)
        long = np.zeros(len(at), bool)
        for a, b in LONG:
            long |= (one == ord(a)) & (two == ord(b))
        long &= at + 2 < room
        for found, size in ((at[short], 2), (at[long & ~short], 3)):
            start[found + 1] = False
            if size == 3:
                start[found + 2] = False
            after = found + size
            after = after[after < n]
            start[after[(kinds[after] == LETTER)]] = True
    return np.flatnonzero(start)


class Encoder:
    """Of one tokenizer file, in one process."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(x["content"] for x in spec.get("added_tokens") or ())
        self.piece = self._piece_encoder(spec)
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.entries = np.zeros(0, _U), np.zeros(0, np.int64)
        self.key_starts, self.key_lengths, self.keys = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.offsets, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @staticmethod
    def _piece_encoder(spec: dict):
        """The same merges for one pre-token, if the file is byte-level BPE whose ids follow the merges' order."""
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec.get("normalizer") or pre != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": pre.get("trim_offsets"), "use_regex": True}:
            return None
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printed))}
        special = {x["content"] for x in spec.get("added_tokens") or ()}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if len(vocab) != 256 + len(merges) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        import tiktoken

        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _by_library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, unsigned 32-bit; null is empty."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        odd = [i for i, x in enumerate(texts) if x and (self.piece is None or any(s in x for s in self.special))]
        skip, group, size = set(odd), [], 0
        for i, x in enumerate(texts):
            if x and i not in skip:
                group.append(i)
                size += len(x)
                if size >= BLOCK:
                    odd += self._block(texts, group, out)
                    group, size = [], 0
        if group:
            odd += self._block(texts, group, out)
        for i, ids in zip(odd, self._by_library([texts[i] for i in odd]) if odd else []):
            out[i] = ids
        give_back()
        return out

    def _block(self, texts: list, group: list[int], out: list[np.ndarray]) -> list[int]:
        raw = [texts[i].encode("utf-32-le", "surrogatepass") for i in group]
        points = np.frombuffer(b"".join(raw), "<u4")
        begins = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])])
        kinds = _classes()[points]
        unsure = np.add.reduceat(kinds == UNSURE, begins[:-1]) > 0
        if unsure.any():
            odd = [i for i, u in zip(group, unsure) if u]
            if rest := [i for i, u in zip(group, unsure) if not u]:
                self._block(texts, rest, out)
            return odd
        starts = cut(points, kinds, begins)
        offsets = pa.py_buffer((np.append(starts, len(points)).astype(np.int64) * 4).tobytes())
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(points)]).dictionary_encode()
        at, back = self._places(pieces.dictionary), pieces.indices.to_numpy(zero_copy_only=False)
        per = self.lengths[at][back]
        total = np.cumsum(per)
        take = np.repeat(self.offsets[at][back] - (total - per), per) + np.arange(total[-1] if len(total) else 0)
        ids = self.flat[take]
        stops = np.concatenate([[0], total])[np.searchsorted(starts, begins)]
        for k, i in enumerate(group):
            out[i] = ids[stops[k] : stops[k + 1]]
        return []

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """The entries that hold the ids of different pre-tokens (UTF-32); new ones are encoded.

        Entries are found by a hash of length and first characters and compared whole. One whose hash another has already gets an entry that is not found again.
        """
        if len(self.offsets) > KEPT:
            self._forget()
        bounds = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1] // 4
        points, starts, lengths = np.frombuffer(pieces.buffers()[2], np.uint32), bounds[:-1], np.diff(bounds)
        own = lengths.astype(_U)
        for k in range(min(LOOKED_AT, int(lengths.max(initial=0)))):
            longer = np.flatnonzero(lengths > k)
            own[longer] = mix(own[longer] ^ (points[starts[longer] + k].astype(_U) << _U(32)))
        at = np.searchsorted(self.hashes, own)
        taken = np.zeros(len(own), bool)
        inside = at < len(self.hashes)
        taken[inside] = self.hashes[at[inside]] == own[inside]
        entry = np.full(len(own), -1)
        entry[taken] = self.entries[at[taken]]
        held = np.flatnonzero(taken)
        held = held[self.key_lengths[entry[held]] == lengths[held]]
        sizes = lengths[held]
        step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        equal = points[np.repeat(starts[held], sizes) + step] == self.keys[np.repeat(self.key_starts[entry[held]], sizes) + step]
        same = held[np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)] if len(held) else held
        known = np.zeros(len(own), bool)
        known[same] = True
        new = np.flatnonzero(~known)
        if len(new):
            made = [self.piece(points[a : a + n].tobytes().decode("utf-32-le", "surrogatepass").encode()) for a, n in zip(starts[new], lengths[new])]
            counts = np.fromiter(map(len, made), np.int64, len(made))
            entry[new] = len(self.offsets) + np.arange(len(new))
            self.offsets = np.concatenate([self.offsets, len(self.flat) + np.cumsum(counts) - counts])
            self.lengths = np.concatenate([self.lengths, counts])
            self.flat = np.concatenate([self.flat, np.fromiter((t for x in made for t in x), np.uint32, int(counts.sum()))])
            sizes = lengths[new]
            step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            self.key_starts = np.concatenate([self.key_starts, len(self.keys) + np.cumsum(sizes) - sizes])
            self.key_lengths = np.concatenate([self.key_lengths, sizes])
            self.keys = np.concatenate([self.keys, points[np.repeat(starts[new], sizes) + step]])
            first = np.unique(own[new], return_index=True)[1]
            free = new[first][~taken[new[first]]]
            self.hashes, self.entries = np.insert(self.hashes, at[free], own[free]), np.insert(self.entries, at[free], entry[free])
        return entry


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
