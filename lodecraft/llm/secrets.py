"""Secret scans: candidates by pattern, false positives removed by a random forest trained from labelled findings."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled findings that the forest is fitted on, at most.
MAX_FINDINGS = 6000
TREES, DEPTH, THRESHOLD = 40, 9, 0.5
#: Characters on either side of a candidate that count as its neighbourhood.
NEAR = 48
KEYWORDS = ("token", "secret", "passw", "pwd", "api_key", "api-key", "apikey", "access_key", "access-key", "auth", "credential")
_NAME = r"(?:[A-Za-z0-9_.-]*(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth(?:orization)?|credentials?)[A-Za-z0-9_.-]*)"
#: (kind, parts of which a text that holds one has some, pattern with the secret in group 1). Secrets go to the end of their run, whatever its length;
#: a match without group 1 only skips a run in which no later start can match, so that texts are read in linear time.
PATTERNS = (
    ("private_key", ("PRIVATE KEY",), re.compile(r"(-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:[^-]++|-(?!----(?:BEGIN|END) ))++-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----)")),
    ("access_id", ("AKIA", "ASIA", "AGPA", "AIDA", "AROA"), re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{12,16})(?![A-Za-z0-9])")),
    ("prefixed", ("gh", "glpat", "k_live", "k_test", "xox", "npm_", "pypi-", "hf_", "dop_v1_", "shp", "sk-", "SG.", "AIza"), re.compile(r"(?<![A-Za-z0-9])((?:gh[pousr][_-]|github_pat_|glpat[_-]|[rs]k_(?:live|test)_|xox[abeoprs]-|npm_|pypi-|hf_|dop_v1_|shp(?:at|ca|pa|ss)_|sk-|SG\.|AIza)[A-Za-z0-9_-]{10,}+(?:\.[A-Za-z0-9_-]{10,}+)*+)")),
    ("web_token", ("eyJ",), re.compile(r"(?<![A-Za-z0-9])(?:(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*+)|eyJ[A-Za-z0-9_-]*+)")),
    ("url_password", ("://",), re.compile(r"://[^\s/:@\"'<>]*+:([^\s/@\"'<>]{3,}+)@")),
    ("assigned", (), re.compile(rf"(?i){_NAME}[\"']?[ \t]{{0,3}}(?:=>|:=|[=:])[ \t]{{0,3}}[\"']?([^\s\"',;<>(){{}}]{{6,}})")),
    ("long_run", (), re.compile(r"(?<![A-Za-z0-9+/_=-])((?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{24,}+)")),
)
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{24}")
_HINT = re.compile(r"(?i)secret|token|passw|pwd|key|auth|credential|private")
_HARMLESS = re.compile(r"(?i)commit|sha-?\d|md5|checksum|digest|hash|etag|revision|uuid|integrity|example|sample|placeholder|dummy|test|https?:|href|src=|image|version|build|id=")
_TESTED = re.compile(r"(?i)test|example|sample|doc|fixture|mock|demo")
FEATURES = ("length", "digits", "uppers", "distinct", "entropy", "hex", "transitions", "words", "repeats", "keyed", "hinted", "harmless", "path", "quoted", "kind", "dashes")


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what may be a secret; they do not overlap, earlier kinds of ``PATTERNS`` going first."""
    found: list[tuple[int, int, str]] = []  # by start; what is in it does not overlap, so a candidate can only meet its two neighbours
    for kind, parts, pattern in PATTERNS:
        if kind == "assigned":
            low = text.lower()
            if not any(k in low for k in KEYWORDS):
                continue
        elif kind == "long_run":
            if not _RUN.search(text):
                continue
        elif not any(x in text for x in parts):
            continue
        new = []
        for m in pattern.finditer(text):
            a, b = m.span(1)
            if a < 0:
                continue
            while b > a + 1 and text[b - 1] in ".!?":
                b -= 1
            k = bisect_left(found, (a,))
            if (k == 0 or found[k - 1][1] <= a) and (k == len(found) or found[k][0] >= b):
                new.append((a, b, kind))
        found = list(merge(found, new))
    return found


@lru_cache(2)
def dictionary(path: str | None) -> frozenset[str]:
    """The words of 4 letters and more in a byte-level vocabulary."""
    import json

    from .tokens import default_path

    with open(path or default_path(), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return frozenset(x.lower() for t in vocab if (x := t.lstrip("Ġ")).isascii() and x.isalpha() and 4 <= len(x) <= 14)


def _coverage(value: str, words: frozenset[str]) -> float:
    """The share of characters inside dictionary words, longest first at each place."""
    low, at, covered = value.lower(), 0, 0
    n = len(low)
    while at < n:
        for size in range(min(14, n - at), 3, -1):
            if low[at : at + size] in words:
                covered += size
                at += size
                break
        else:
            at += 1
    return covered / max(1, n)


def _kinds(value: str) -> np.ndarray:
    """Each character as one of 40 symbols."""
    codes = np.full(128, 39, np.uint8)
    codes[48:58] = np.arange(10)
    codes[97:123] = np.arange(10, 36)
    codes[65:91] = np.arange(10, 36)
    codes[[ord("-"), ord("_")]] = 36
    codes[[ord("/"), ord("+")]] = 37
    codes[[ord("="), ord(".")]] = 38
    return codes[np.frombuffer(value.encode("ascii", "replace"), np.uint8) & 127]


class Model:
    """Character transitions of words and a forest, both from labelled findings."""

    def __init__(self, findings: list[tuple[str, str, str, str, str, bool]], words: frozenset[str], seed: int = 20240601):
        """``findings``: (text before, value, text after, path, kind, is a secret)."""
        if len(findings) > MAX_FINDINGS:
            raise ValueError(f"at most {MAX_FINDINGS} labelled findings")
        self.words = words
        logs = []
        for label in (True, False):
            counts = np.full((40, 40), 0.5)
            for _, value, _, _, _, truth in findings:
                if truth is label:
                    k = _kinds(value)
                    np.add.at(counts, (k[:-1], k[1:]), 1)
            logs.append(np.log(counts / counts.sum(axis=1, keepdims=True)))
        self.odds = logs[0] - logs[1]
        x = np.array([self.features(*f[:5]) for f in findings])
        self.trees = _fit(x, np.array([f[5] for f in findings], float), seed)

    def features(self, before: str, value: str, after: str, path: str, kind: str) -> list[float]:
        n, k = len(value), _kinds(value)
        counts = np.array(list(_count(value).values())) / n
        return [
            min(n, 400), sum(c.isdigit() for c in value) / n, sum(c.isupper() for c in value) / n, len(set(value)) / min(n, 64),
            float(-(counts * np.log2(counts)).sum()), sum(c in string.hexdigits for c in value) / n,
            float(self.odds[k[:-1], k[1:]].mean()) if n > 1 else 0.0, _coverage(value, self.words),
            _longest_repeat(value),
            float(kind == "assigned"), float(bool(_HINT.search(before[-NEAR:]))), float(bool(_HARMLESS.search(before[-NEAR:]) or _HARMLESS.search(after[: NEAR // 2]))),
            float(bool(_TESTED.search(path))), float(before[-1:] in "\"'" if before else False), [p[0] for p in PATTERNS].index(kind), value.count("-") / n,
        ]

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        x = np.array(rows, float).reshape(-1, len(FEATURES))
        return np.mean([_walk(t, x) for t in self.trees], axis=0) if len(x) else np.zeros(0)


def _count(value: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for c in value:
        out[c] = out.get(c, 0) + 1
    return out


def _longest_repeat(value: str) -> float:
    best = run = 1
    for a, b in zip(value, value[1:]):
        run = run + 1 if a == b else 1
        best = max(best, run)
    return best / len(value)


def _fit(x: np.ndarray, y: np.ndarray, seed: int) -> list[tuple[np.ndarray, ...]]:
    """Trees as arrays (feature, limit, left, right, value), each from a bootstrap sample and random features at each node."""
    rng = np.random.default_rng(seed)
    per_node = max(1, round(math.sqrt(x.shape[1])))
    trees = []
    for _ in range(TREES):
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, depth: int) -> int:
            me = len(nodes)
            p = float(y[rows].mean())
            nodes.append([-1, 0.0, -1, -1, p])
            if depth == DEPTH or len(rows) < 8 or p in (0.0, 1.0):
                return me
            best = (1e9, -1, 0.0)
            for f in rng.choice(x.shape[1], per_node, replace=False):
                column = x[rows, f]
                for limit in np.unique(np.quantile(column, np.linspace(0.05, 0.95, 13))):
                    low = column <= limit
                    a, b = int(low.sum()), int((~low).sum())
                    if a and b:
                        pa_, pb = y[rows][low].mean(), y[rows][~low].mean()
                        gini = a * pa_ * (1 - pa_) + b * pb * (1 - pb)
                        if gini < best[0] - 1e-12:
                            best = (gini, int(f), float(limit))
            if best[1] >= 0:
                low = x[rows, best[1]] <= best[2]
                nodes[me][:2] = [best[1], best[2]]
                nodes[me][2] = grow(rows[low], depth + 1)
                nodes[me][3] = grow(rows[~low], depth + 1)
            return me

        grow(rng.integers(0, len(x), len(x)), 0)
        a = np.array(nodes)
        trees.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
    return trees


def _walk(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    feature, limit, left, right, value = tree
    at = np.zeros(len(x), int)
    for _ in range(DEPTH):
        f = feature[at]
        inner = f >= 0
        go_left = x[np.arange(len(x)), np.maximum(f, 0)] <= limit[at]
        at = np.where(inner, np.where(go_left, left[at], right[at]), at)
    return value[at]


def labelled_findings(n: int, seed: int, words: frozenset[str]) -> list[tuple[str, str, str, str, str, bool]]:
    """``n`` labelled findings: keys, tokens and passwords, and the look-alikes that scanners report wrongly."""
    rng = random.Random(seed)
    vocabulary = sorted(words)
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    word = lambda: rng.choice(vocabulary)
    prose = lambda: " ".join(word() for _ in range(6)) + " "
    hexa, base, upper = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits
    secret_names, other_names = ("token", "password", "secret", "api_key", "auth_token", "passwd", "client_secret", "access_key"), ("commit", "sha1", "md5", "checksum", "etag", "revision", "digest", "integrity sha256", "build", "uuid")
    paths = ("src/app.py", "config/settings.yml", "deploy.env", "main.go", "web", "")
    test_paths = ("tests/test_app.py", "docs/example.md", "fixtures/mock.json", "samples/demo.txt")
    out = []
    for i in range(n):
        quote = rng.choice(('"', "'", "", ""))
        joint = rng.choice(("=", " = ", ": ", ":"))
        if i % 2 == 0:
            form = rng.randrange(8)
            value = (lambda: rng.choice(("AKIA", "ASIA")) + pick(upper, 16), lambda: pick(hexa, rng.choice((16, 18, 24, 32, 40, 64))), lambda: pick(base, rng.randint(20, 64)), lambda: pick(string.ascii_letters + string.digits + "!@#$%^&*", rng.randint(8, 20)), lambda: rng.choice(("ghp_", "sk_live_", "xoxb-", "glpat-", "npm_", "hf_", "sk-", "AIza", "SG.")) + pick(base[:62], rng.randint(20, 40)), lambda: f"eyJ{pick(base[:62], 17)}.{pick(base[:62], 40)}.{pick(base[:62], 43)}", lambda: pick(base[:62] + "!#$%*", rng.randint(8, 24)), lambda: rng.choice((word() + str(rng.randint(10, 9999)) + rng.choice("!#$*"), word().title() + pick(base[:62], 6), word() + rng.choice("-_.") + word() + str(rng.randint(10, 9999)))))[form]()
            kind = ("access_id", "assigned", "assigned", "assigned", "prefixed", "web_token", "url_password", rng.choice(("url_password", "assigned")))[form]
            before = prose() + (f"{rng.choice(('postgres', 'https', 'mysql', 'redis'))}://{word()}:" if kind == "url_password" else rng.choice(secret_names) + joint + quote if kind == "assigned" else rng.choice(("", "key ", "", rng.choice(secret_names) + joint + quote)))
            out.append((before, value, quote + " " + prose(), rng.choice(paths if rng.random() < 0.9 else test_paths), kind, True))
        else:
            form = rng.randrange(8)
            value = (lambda: rng.choice(("changeme", "your_token_here", "xxxxxxxxxxxx", "password123", "example-key", "<insert>", "********", "placeholder", "undefined", "required", "optional")), lambda: "_".join(word() for _ in range(rng.randint(2, 5))), lambda: pick(hexa, rng.choice((32, 40, 64))), lambda: f"{pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}", lambda: "".join(word().title() for _ in range(rng.randint(3, 6))) + str(rng.randint(1, 99)), lambda: "/".join(word() for _ in range(rng.randint(3, 6))) + f"/{rng.randint(1, 9999)}", lambda: rng.choice("AaxX0") * rng.randint(8, 30) if rng.random() < 0.5 else word() + "." + word(), lambda: rng.choice(("password", "pass", "PASSWORD", "secret", "xxxx", "example", "user", "changeme", "your-password", "********", "${PASSWORD}", "%s")))[form]()
            if form == 7:
                kind, before = "url_password", prose() + f"{rng.choice(('postgres', 'https', 'mysql', 'redis'))}://{rng.choice(('user', 'username', 'me', word()))}:"
            elif form in (0, 1, 6):
                kind, before = "assigned", prose() + rng.choice(secret_names) + joint + quote
            else:
                kind, before = "long_run", prose() + (rng.choice(other_names) + rng.choice((" ", ": ", "=")) if form in (2, 3) else "")
                value = value.ljust(24, "0") if form in (4, 5) else value
            out.append((before, value, quote + " " + prose(), rng.choice(test_paths if rng.random() < 0.4 else paths), kind, False))
    return out


@lru_cache(2)
def trained(n: int = 2400, seed: int = 11, path: str | None = None) -> Model:
    """The forest of this library, from ``n`` labelled findings."""
    words = dictionary(path)
    return Model(labelled_findings(n, seed, words), words)


def _judge(model: Model, text: str, path: str) -> list[tuple[int, int, str, float]]:
    spans = candidates(text)
    if not spans:
        return []
    rows = [model.features(text[max(0, a - 200) : a], text[a:b], text[b : b + 100], path, kind) for a, b, kind in spans]
    return [(a, b, kind, float(s)) for (a, b, kind), s in zip(spans, model.scores(rows))]


def scan(docs: DataFrame, model: Model | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, start, length, kind, value_sha256, score, is_secret): every candidate in every text, in one narrow pass.

    Spans count characters. The forest's score is the share of trees' votes for a secret; ``is_secret`` from ``threshold`` on.
    The value itself is not returned. Null and empty texts have no candidates; a null path is an empty one. Repeated rows are scanned
    each; ids may be null. Texts of any length are scanned one at a time, whole, in linear time. Other columns, whatever their names, are ignored. No rows: no rows.
    """
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "kind", "value_sha256", "score", "is_secret"]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_())
        for batch in batches:
            rows = []
            for doc, text, path in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for a, b, kind, score in _judge(model, text or "", path or ""):
                    digest = hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((doc, a, b - a, kind, digest, round(score, 6), score >= threshold))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(path_col).cast("string").alias("path"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, kind string, value_sha256 string, score double, is_secret boolean")


def redact(docs: DataFrame, model: Model | None = None, threshold: float = THRESHOLD, text_col: str = "text", path_col: str = "source", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each secret replaced, whole, by ``[kind]``; all rows stay. ``size_col`` follows the text where it changed.

    Null and empty texts stay as they are; a null path is an empty one; repeated rows are treated alike. Columns may have any names and types, and
    keep them. Texts of any length are handled one by one. No rows: no rows.
    """
    model = model or trained()
    names = docs.columns
    text_at, path_at = names.index(text_col), names.index(path_col)
    size_at = names.index(size_col) if size_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, paths = batch.column(text_at).to_pylist(), batch.column(path_at).to_pylist()
            sizes = batch.column(size_at).to_pylist() if size_at is not None else None
            changed = False
            for i, text in enumerate(texts):
                found = [x for x in _judge(model, text or "", str(paths[i] or "")) if x[3] >= threshold]
                for a, b, kind, _ in reversed(found):
                    texts[i] = f"{texts[i][:a]}[{kind}]{texts[i][b:]}"
                if found:
                    changed = True
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            if not changed:
                yield batch
                continue
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            if sizes is not None:
                columns[size_at] = pa.array(sizes, batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
