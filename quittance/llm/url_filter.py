"""URL filter: rules indexed by their rarest literal token; a url's tokens fetch the rules to try.

A rule is a pattern over `host + path` (or the whole url), with the literal tokens
(runs of a-z and 0-9 between other characters, lower-cased) that any match must hold
whole. Over all urls, the occurrences of the rules' tokens are counted, and each
rule is filed under its rarest one (ties: the first in order); rules without such a token are tried on every url. A url
then runs the regular expressions of the rules its own tokens fetch, and of no others; they are compiled when first tried.

Host rules (allow or block by host suffix and path prefix) decide first, the longest
that fits; other urls are judged by filter rules in the common list syntax (see filter_rules): a url that any
blocking rule fits is blocked unless an exception (@@) fits it too.

The rule list is a parameter held by the driver and broadcast; its number of rules is checked (`max_rules`), and with it
the size of what a worker holds.

Rules that say something else than "block this page" by an option after a $ (a type of request, a list of domains, hiding of elements)
are left out, and skipped_rules lists them.

Cases: null urls and urls without :// have empty host and path, no host rule and
verdict allow unless a filter on whole urls fits; very long urls are read whole; of host rules tied in length the later
name and verdict in order wins; repeated urls are judged row by row; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .common import UPPER, kept, map_texts

OUT = "host string, path string, rule string, verdict string, tried bigint"
TOKEN = re.compile(r"[a-z0-9]+")
SPLIT = r"[^a-z0-9]+"


@dataclass(frozen=True)
class HostRule:
    """Fits the host, all its subdomains, and paths that start with `path` (it starts with /)."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return rf"^(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        whole = self.name.lower()
        # the last run of a path prefix may go on in the url: no whole token
        return [m[0] for m in TOKEN.finditer(whole) if m.end() < len(whole)]


@dataclass(frozen=True)
class Filter:
    """A regular expression over the lower-cased url, with the tokens any match must hold whole."""

    pattern: str
    tokens: tuple[str, ...]
    verdict: str = "block"


#: what stands for ^ (a separator or the end) and || (the start of the host or of a label of it)
SEPARATOR, LABEL = r"(?:[^a-z0-9_.%-]|$)", r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*[.@])?"


#: options after $ under which a rule still speaks of whole pages; any other narrows a rule or changes what it does
PAGE_OPTIONS = frozenset({"document", "doc", "all", "important"})
_OPTIONS = re.compile(r"\$([A-Za-z0-9~=|,._*-]+)$")
_REGEX = re.compile(r"/(.+)/")


def _options(text: str) -> tuple[str, list[str]]:
    """A rule without its exception mark, and its options."""
    m = _OPTIONS.search(text)
    # a $ inside /.../ belongs to the regular expression
    return (text[: m.start()], m[1].lower().split(",")) if m and not _REGEX.fullmatch(text) else (text, [])


def is_rule(line: str) -> bool:
    """Whether a line speaks of urls: no comment, empty line or element-hiding rule."""
    text = line.strip()
    return bool(text) and text[0] not in "![" and not re.search(r"#[@?]?#", text)


def filter_rule(line: str) -> Filter | None:
    """One line of a filter list; None for lines that are no rules, and for rules with options other than PAGE_OPTIONS.

    || label of the host, | start or end, * anything, ^ separator, /.../ regular expression (upper and lower case alike), @@ exception.
    """
    if not is_rule(line):
        return None
    text = line.strip()
    verdict, text = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    text, options = _options(text)
    if not PAGE_OPTIONS.issuperset(options):
        return None
    if m := _REGEX.fullmatch(text):
        return Filter(f"(?i:{m[1]})", (), verdict)
    text = text.lower()
    head, tail = LABEL if text.startswith("||") else "^" if text.startswith("|") else "", "$" if text.endswith("|") else ""
    body = text.lstrip("|").rstrip("|") if tail else text.lstrip("|")
    regex = "".join({"*": ".*", "^": SEPARATOR}.get(c, re.escape(c)) for c in body)
    # a run at an open end, or beside *, may go on in the url
    whole = [
        m[0] for m in TOKEN.finditer(body)
        if (m.start() > 0 or head) and (m.end() < len(body) or tail) and body[m.start() - 1 : m.start()] != "*" and body[m.end() : m.end() + 1] != "*"
    ]
    return Filter(head + regex + tail, tuple(whole), verdict) if body else None


def filter_rules(lines: Iterable[str]) -> tuple[Filter, ...]:
    """The rules of a list, in order."""
    return tuple(r for r in map(filter_rule, lines) if r)


def skipped_rules(lines: Iterable[str]) -> list[str]:
    """The lines of a list that are rules, but are left out for their options."""
    return [x for x in lines if is_rule(x) and filter_rule(x) is None]


#: The list where none is given (invented): hosts of spam and of what is unfit for training, and pages of machinery.
DEFAULT_LIST = """
! spam
||cheap-pills.
||spam-farm.
||free-bets.
||online-casino.
||casino.
||casino-
-casino.
-casino-
! adult
||porn.
||xxx.
-porn.
-xxx.
! advertising and log-in pages
||ads.
||adserver.
||doubleclick.
/wp-login.php^
"""


def token_counts(urls: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """Occurrences over all urls of the given tokens (as many rows as tokens at most)."""
    if not tokens:
        return {}
    wanted = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string"))  # a rule list's tokens
    found = urls.select(F.explode(F.split(F.lower("url"), SPLIT)).alias("token")).join(wanted, "token", "left_semi")
    return {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}


class RuleIndex:
    def __init__(self, hosts: Sequence[HostRule], filters: Sequence[Filter], counts: dict[str, int]):
        self.by_token: dict[str, list] = {}
        self.always: list = []
        for kind, rules in (("host", hosts), ("filter", filters)):
            for r in rules:
                entry = [kind, None, r]
                if tokens := set(r.tokens):
                    self.by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
                else:
                    self.always.append(entry)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int]:
        """host, path, rule, verdict, regular expressions run."""
        host, path = split_url(url)
        lowered, site = (url or "").lower(), host + path
        best, fits, tried = None, set(), 0
        fetched = [e for t in set(TOKEN.findall(lowered)) if t in self.by_token for e in self.by_token[t]]
        for entry in [*fetched, *self.always]:
            kind, regex, rule = entry
            if kind == "filter" and rule.verdict in fits:
                continue  # one that fits is enough
            tried += 1
            if regex is None:
                regex = entry[1] = re.compile(rule.pattern)
            if not regex.search(site if kind == "host" else lowered):
                continue
            if kind == "filter":
                fits.add(rule.verdict)
            elif best is None or (len(rule.name), rule.name, rule.verdict) > (len(best.name), best.name, best.verdict):
                best = rule
        verdict = best.verdict if best else "block" if fits == {"block"} else "allow"
        return host, path, best.name if best else None, verdict, tried


_LOWER = str.maketrans(UPPER, UPPER.lower())


def split_url(url: str | None) -> tuple[str, str]:
    _, there, rest = (url or "").partition("://")
    if not there:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return m[1].translate(_LOWER), m[2]


def filter_urls(pages: DataFrame, hosts: Sequence[HostRule], filters: Sequence[Filter] | None = None, carry: Sequence[str] = ("page_id",), max_rules: int = 100_000) -> DataFrame:
    """row (struct of `carry`), out (host, path, rule, verdict, tried: regular expressions run). filters: DEFAULT_LIST if None."""
    filters = filter_rules(DEFAULT_LIST.splitlines()) if filters is None else filters
    if len(hosts) + len(filters) > max_rules:
        raise ValueError(f"{len(hosts) + len(filters)} rules; at most {max_rules} are held by a worker")
    counts = token_counts(pages, sorted({t for r in [*hosts, *filters] for t in r.tokens}))
    sc = pages.sparkSession.sparkContext
    shared = sc.broadcast((list(hosts), list(filters), counts))
    name = f"url filter {sc.applicationId}-{shared._jbroadcast.id()}"

    def make():
        index = kept(name, None, lambda: RuleIndex(*shared.value))

        def apply(urls):
            return list(zip(*[index.judge(None if u is None else u.decode()) for u in urls])) or [[]] * 5

        return apply

    return map_texts(pages, carry, make, OUT, text="url")
