"""URL rules, indexed by their rarest literal token.

A rule is a regular expression over host and path that names the literal tokens every
match must contain. Each rule is filed under one of its tokens, the one fewest rules
share; a URL looks up its own tokens and runs only the expressions found there. Rules
are a parameter of bounded size and travel with the task; the URLs are read once and
nothing is shuffled.

Null or scheme-less URLs have empty host and path: no rule fits, the verdict is "allow".
Repeated rows are judged alike, empty tables give empty results, other columns are ignored."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TOKEN = re.compile(r"[^\W_]+")

#: Host words that mark a site as unwanted where no list rule speaks.
UNWANTED = ("ads", "adult", "casino", "pills", "porn", "spam", "track", "viagra", "xxx")


@dataclass(frozen=True)
class Rule:
    """`pattern` is matched from the start of host + NUL + path; `tokens` occur in every match."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.translate(_LOWER))


def site_rule(verdict: str, site: str) -> Rule:
    """A rule for a host with its subdomains and a path prefix, such as `example.com/en/`."""
    host, slash, path = site.partition("/")
    path = slash + path
    whole = _TOKEN.sub(lambda m: m[0] if m.end() < len(path) else "", path)  # a last open token may go on
    return Rule(site, verdict, rf"(?:[^\0]*\.)?{re.escape(host.translate(_LOWER))}\0{re.escape(path)}",
                (*tokens(host), *tokens(whole)))


def word_rule(verdict: str, word: str) -> Rule:
    """A rule for hosts that hold a word between separators."""
    return Rule(word, verdict, rf"(?:[^\0]*[^a-z0-9\0])?{re.escape(word)}(?:[^a-z0-9\0][^\0]*)?\0", tuple(tokens(word)))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_LOWER), re.match(r"[^?#]*", rest[len(host):])[0]


class RuleIndex:
    """Rules by their rarest token; rules without a token are tried on every URL."""

    def __init__(self, rules: Iterable[Rule]):
        rules = list(rules)
        uses = Counter(t for r in rules for t in set(r.tokens))
        self.always: list[tuple[Rule, re.Pattern]] = []
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = defaultdict(list)
        for rule in rules:
            entry = (rule, re.compile(rule.pattern, re.DOTALL))
            if rule.tokens:
                self.by_token[min(rule.tokens, key=lambda t: (uses[t], -len(t), t))].append(entry)
            else:
                self.always.append(entry)

    def matches(self, host: str, path: str) -> list[Rule]:
        subject, found = f"{host}\0{path}", list(self.always)
        for token in set(tokens(subject)):
            found += self.by_token.get(token, ())
        return [rule for rule, pattern in found if pattern.match(subject)]


def judge(urls: DataFrame, sites: Iterable[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url",
          unwanted: Iterable[str] = UNWANTED) -> DataFrame:
    """Per row: id, host, path, rule, verdict, reason.

    The longest site rule that fits decides (of equally long ones a block, then the smaller
    name); else a word rule blocks; else the URL is allowed. `rule` is the site rule or
    null, `reason` the word rule that decided or null."""
    site_index = RuleIndex(site_rule(v, s) for v, s in sites)
    word_index = RuleIndex(word_rule("block", w) for w in unwanted)
    kind = urls.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                site = min(site_index.matches(host, path), key=lambda r: (-len(r.name), r.verdict != "block", r.name), default=None) if host or path else None
                word = None if site else min((r.name for r in word_index.matches(host, path)), default=None)
                out.append((host, path, site and site.name, site.verdict if site else "block" if word else "allow", word))
            columns = [pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "host", "path", "rule", "verdict", "reason"])

    judged = urls.select(urls[id_col].alias("id"), urls[url_col].alias("url")).mapInArrow(
        run, f"id {kind}, host string, path string, rule string, verdict string, reason string")
    return judged.withColumnRenamed("id", id_col)
