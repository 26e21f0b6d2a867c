"""Text functions: canonical form, hashes, ids, shingles, bounded truncation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What str.split() takes as white space, as a Java pattern.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: The same but for the blank, one by one.
_ODD = "".join(map(chr, [*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SHINGLE = 5
PERMUTATIONS = 128


def collapse(text: Column) -> Column:
    """White space of any kind to single blanks, trimmed. Only texts with a run of it meet a pattern."""
    flat = F.translate(text, _ODD, " " * len(_ODD))
    return F.trim(F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " {2,}", " ")).otherwise(flat))


#: Characters that ICU's tables (Unicode 16) compose, decompose or reorder and those of Python (15.1) do not know: they stand as they are, and nothing moves across them.
_NEWER = r"\x{897}\x{105c0}-\x{105ff}\x{10d40}-\x{10d8f}\x{11380}-\x{113ff}\x{16100}-\x{1613f}\x{16d40}-\x{16d7f}\x{1ccd6}-\x{1ccf9}\x{1e5d0}-\x{1e5ff}"


def _nfkc(text: Column) -> Column:
    """Python's ``unicodedata.normalize("NFKC", x)`` by the ICU that Spark brings along: no text crosses to Python."""
    made = lambda x: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    newer = f"[{_NEWER}]"
    parts = F.regexp_extract_all(text, F.lit(f"{newer}|[^{_NEWER}]+"), F.lit(0))
    return F.when(text.rlike(newer), F.array_join(F.transform(parts, lambda x: F.when(x.rlike(newer), x).otherwise(made(x))), "")).otherwise(made(text))


def canonical_text(text: Column) -> Column:
    """NFKC, white space collapsed, trimmed.

    ASCII and the Latin-1 letters are their own normal form. Only other texts are normalised.
    """
    odd = (F.octet_length(text) != F.length(text)) & text.rlike(r"[^\x00-\x7f\xc0-\xff]")
    return collapse(F.when(odd, _nfkc(text)).otherwise(text))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def task_id(dataset: Column, canonical: Column) -> Column:
    """Content-addressed: dataset, colon, the first 20 hex digits of the canonical text's digest."""
    return F.concat(dataset, F.lit(":"), F.left(sha256_hex(canonical), F.lit(20)))


def shingles(canonical: Column, n: int = SHINGLE) -> Column:
    """Distinct runs of n characters; a shorter text is its own only shingle."""
    each = F.regexp_extract_all(canonical, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))  # linear; substring at i would cost i
    pairs = canonical.rlike("[\\x{10000}-\\x{10ffff}]")  # the pattern would also begin inside these
    slow = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(canonical) - (n - 1))), lambda i: F.substring(canonical, i, F.lit(n)))
    return F.when(F.length(canonical) < n, F.array(canonical)).when(pairs, F.array_distinct(slow)).otherwise(F.array_distinct(each))


def shingle_hashes(canonical: str, n: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``shingles`` of a text: a polynomial of the code points, with its bits mixed."""
    points = np.frombuffer(canonical.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    width = min(n, len(points))
    total = np.zeros(len(points) - width + 1, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9FB21C651E98DF25) + points[k : k + len(total)] + np.uint64(1)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        total = (total ^ (total >> np.uint64(shift))) * np.uint64(factor)
    return np.unique(total ^ (total >> np.uint64(33)))


def utf8_truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes, never half a character: a native loop-free search from the byte limit downwards.

    A character is at most four bytes, so the longest prefix within the limit has the limit's bytes or up to three
    fewer: the cut falls before the last byte that begins a character.
    """
    raw = text.cast("binary")
    size = F.octet_length(text)

    def begins(k: int) -> Column:
        byte = F.conv(F.hex(F.substring(raw, F.lit(limit - k + 1), F.lit(1))), 16, 10).cast("int")
        return (byte < 128) | (byte >= 192)

    cut = F.lit(max(0, limit - 3))
    for k in (2, 1, 0):
        if limit - k >= 0:
            cut = F.when(begins(k), F.lit(limit - k)).otherwise(cut)
    return F.when(size <= limit, text).otherwise(F.substring(raw, F.lit(1), cut).cast("string"))


def normalize_surface(canonical: Column) -> Column:
    """Canonical text with U+2212 as ``-``, one spelling of fractions and outer math delimiters removed, however deep: a round for each that the text holds."""
    out = F.regexp_replace(F.translate(canonical, "\u2212", "-"), r"\\[dt]frac\b", r"\\\\frac")

    def strip(x: Column) -> Column:
        cases = None
        for left, right in (("$$", "$$"), ("\\[", "\\]"), ("\\(", "\\)"), ("$", "$")):
            k = len(left)
            inner = F.trim(F.substring(x, F.lit(k + 1), F.greatest(F.length(x) - 2 * k, F.lit(0))))
            hit = F.startswith(x, F.lit(left)) & F.endswith(x, F.lit(right)) & (F.length(inner) > 0)
            cases = F.when(hit, inner) if cases is None else cases.when(hit, inner)
        return cases.otherwise(x)

    rounds = F.greatest(F.lit(1), F.regexp_count(canonical, F.lit(r"\\[\[(]|\$")))
    return F.when(F.length(canonical) > 0, F.aggregate(F.sequence(F.lit(1), rounds), out, lambda x, _: strip(x))).otherwise(canonical)
