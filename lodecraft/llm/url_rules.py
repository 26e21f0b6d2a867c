"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9]+")
BLOCK, ALLOW = "block", "allow"
#: Characters of all rules that may be shipped to executors with a task.
MAX_RULE_CHARS = 32_000_000

#: Rules for hosts of spam, gambling, adult and tracking sites.
DEFAULT_RULES = tuple((f"||{x}", BLOCK) for x in ("spam-farm.", "cheap-pills.", "free-bets.", "casino-", "adult-", "ads-track."))


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: from there up to ``? #`` or the end."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return _lower(host), path


_LOWER = {i: i + 32 for i in range(65, 91)}


def _lower(text: str) -> str:
    return text.translate(_LOWER)


@dataclass(frozen=True)
class Rule:
    """A pattern over host + path. ``||`` at its start: at a label of the host; ``*``: anything; ``^``: a separator or
    the end; ``|`` at its end: the end. ``name`` is what results show; ``pinned`` rules go before others."""

    pattern: str
    action: str
    name: str
    pinned: bool = False

    @property
    def regex(self) -> str:
        body, head, tail = self.pattern, "", ""
        if body.startswith("||"):
            body, head = body[2:], r"^(?:[^/]*\.)?"
        if body.endswith("|"):
            body, tail = body[:-1], "$"
        parts = {"*": ".*", "^": r"(?:[^0-9A-Za-z_.%-]|$)"}
        return head + "".join(parts.get(c, re.escape(c)) for c in body) + tail

    @property
    def tokens(self) -> list[str]:
        """Literals that any url it fits holds as whole tokens: something that ends a token stands on both sides."""
        body = _lower(self.pattern)
        anchored = body.startswith("||")
        body = body[2:] if anchored else body
        found = []
        for m in TOKEN.finditer(body):
            left = m.start() == 0 and anchored or m.start() > 0 and body[m.start() - 1] != "*"
            right = m.end() < len(body) and body[m.end()] != "*"
            if left and right:
                found.append(m.group())
        return found


def pinned_rules(rules: Iterable[tuple[str, str]]) -> list[Rule]:
    """(``host/path``, action): a rule fits its host and all subdomains, if the path starts with the rule's."""
    out = []
    for text, action in rules:
        if set(text) & set("*^|"):
            raise ValueError(f"{text}: a host/path rule is literal")
        out.append(Rule(f"||{text}", action, text, True))
    return out


class Index:
    """Rules by their rarest token; those without a whole token are tried on every url."""

    def __init__(self, rules: Iterable[Rule], seen: dict[str, int]):
        self.by_token: dict[str, list[tuple]] = {}
        self.always: list[tuple] = []
        for rule in rules:
            entry = (rule, re.compile(rule.regex, re.S))
            tokens = rule.tokens
            if tokens:
                self.by_token.setdefault(min(tokens, key=lambda t: (seen.get(t, 0), t)), []).append(entry)
            else:
                self.always.append(entry)

    def judge(self, host: str, path: str) -> tuple[Rule | None, Rule | None]:
        """The longest pinned rule that fits, and the longest other one (ties: block before allow, then by name)."""
        text = host + path
        entries = list(self.always)
        for token in set(TOKEN.findall(_lower(text))):
            entries += self.by_token.get(token, ())
        fits = [r for r, x in entries if x.search(text)]
        best = lambda own: min(own, key=lambda r: (-len(r.name), r.action != BLOCK, r.name), default=None)
        return best([r for r in fits if r.pinned]), best([r for r in fits if not r.pinned])


def token_counts(pages: DataFrame, wanted: frozenset[str], url_col: str) -> dict[str, int]:
    """In how many urls each wanted token occurs; at most one row a token reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                seen.update(wanted.intersection(TOKEN.findall(_lower("".join(host_and_path(url))))))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    counted = pages.select(F.col(url_col).cast("string").alias("url")).mapInArrow(run, "token string, n long")
    return {r[0]: int(r[1]) for r in counted.groupBy("token").agg(F.sum("n")).collect()}


def judge_urls(pages: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every row.

    Each rule is filed under the one of its whole tokens that fewest urls hold, counted over all urls. A url's tokens
    fetch their rules, and only those run their regular expression. The longest pinned rule that fits decides
    and is named in ``rule``; else the longest other rule that fits (``pattern``); else the url is allowed.

    Rules travel with the task; their size is checked. One narrow pass, after one for the counts. Null urls and urls
    without ``://`` have an empty host and path. Repeated rows are judged each; ids may be null. No rows: no rows.
    """
    rules = list(rules)
    if sum(len(r.pattern) for r in rules) > MAX_RULE_CHARS:
        raise ValueError("too many rules for one index; split them")
    seen = token_counts(pages, frozenset(t for r in rules for t in r.tokens), url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules, seen)
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [])
            for url in batch.column(1).to_pylist():
                host, path = host_and_path(url)
                pinned, other = index.judge(host, path)
                verdict = (pinned or other).action if pinned or other else ALLOW
                for column, value in zip(columns, (host, path, pinned and pinned.name, verdict, other and other.name)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["page_id", "host", "path", "rule", "verdict", "pattern"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, pattern string")
