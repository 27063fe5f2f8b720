"""URL filters: pattern rules indexed by their rarest literal token.

Rules are lines of text (``parse_rules``):

* ``! text``: a comment; ``@@`` before a rule makes it an allow rule, others block.
* ``||host/path``: a site rule. It fits the host and its subdomains where the path starts with the rule's.
* ``/expression/``: a regular expression (ASCII classes), searched in the lower-cased url.
* Anything else is text to be found in the lower-cased url: ``*`` stands for any characters, ``^`` for a
  separator (anything but a-z, 0-9, ``_``, ``-``, ``.``, ``%``) or the end, ``|`` at either end of the rule for
  that end of the url, ``||`` before it for the start of the host or of one of its labels.

All become regular expressions. From a rule's parsed form come its literal tokens: runs of a-z and 0-9 that
every url it fits holds as whole tokens. Each rule is filed under the token that the fewest rules share; a
url's tokens fetch the candidate rules, and only those run their regular expression. Rules without a literal
token are candidates everywhere.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

TOKEN = re.compile(r"[a-z0-9]+")
_TOKEN_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_SEPARATOR, _HOST_START = r"(?:[^a-z0-9_.%-]|\Z)", r"^[^:/?#]*://(?:[^/?#]*\.)?"
#: Parts of a parsed pattern that are no single character: an edge, where no token goes on; anything else.
EDGE, ANY = object(), object()


@dataclass(frozen=True)
class Rule:
    """name: as reported; over: what the expression runs on, ``site`` (host and path) or the whole ``url`` in lower case."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    over: str = "url"


def whole_tokens(parts: Iterable) -> tuple[str, ...]:
    """Tokens among the characters of parts that are whole wherever the pattern matches: both neighbours are an
    ``EDGE`` or a character that is in no token."""
    found, run, whole = [], "", False
    for part in (*parts, ANY):
        if isinstance(part, str) and part in _TOKEN_CHARS:
            run += part
            continue
        if run and whole and part is not ANY:
            found.append(run)
        run, whole = "", part is not ANY
    return tuple(dict.fromkeys(found))


def _takes_token(members: list) -> bool:
    """Whether a parsed character class can match a character of a token."""
    from re import _constants as c

    words = {c.CATEGORY_WORD: True, c.CATEGORY_NOT_WORD: False, c.CATEGORY_SPACE: False, c.CATEGORY_NOT_SPACE: True, c.CATEGORY_DIGIT: "0123456789", c.CATEGORY_NOT_DIGIT: "abcdefghijklmnopqrstuvwxyz"}
    negated, taken = False, set()
    for kind, value in members:
        if kind is c.NEGATE:
            negated = True
        elif kind is c.LITERAL:
            taken.add(chr(value).lower())
        elif kind is c.RANGE:
            taken |= {x for x in _TOKEN_CHARS for y in (x, x.upper()) if value[0] <= ord(y) <= value[1]}
        else:
            chars = words[value]
            taken |= _TOKEN_CHARS if chars is True else set(chars or "")
    return not _TOKEN_CHARS <= taken if negated else bool(_TOKEN_CHARS & taken)


def regex_parts(parsed) -> Iterator:
    """The parts, in order, that every match of a parsed expression has."""
    from re import _constants as c

    edges = (c.AT_BEGINNING, c.AT_BEGINNING_STRING, c.AT_BOUNDARY, c.AT_END, c.AT_END_STRING)
    for kind, value in parsed:
        if kind is c.LITERAL:
            # a letter that some flag lets stand for another is lower-case in a lower-cased url
            yield chr(value).lower()
        elif kind is c.AT:
            yield EDGE if value in edges else ANY
        elif kind is c.IN:
            yield ANY if _takes_token(value) else EDGE
        elif kind is c.SUBPATTERN:
            yield from regex_parts(value[3])
        elif kind is c.MAX_REPEAT and value[0] >= 1:
            inner = list(regex_parts(value[2]))
            yield EDGE if inner and not any(p is ANY or p in _TOKEN_CHARS for p in inner) else ANY
        else:
            yield ANY


def regex_rule(verdict: str, name: str, regex: str) -> Rule:
    from re import _parser

    return Rule(name, verdict, regex, whole_tokens(regex_parts(_parser.parse(regex, re.ASCII))))


def site_rule(verdict: str, name: str) -> Rule:
    """``example.net/en/``: host, its subdomains, and a path that starts with ``/en/``. The last path part
    is no whole token, as a url's may go on."""
    host, slash, path = name.partition("/")
    parts = [EDGE, *host.lower(), EDGE, *(slash + path).lower(), ANY]
    path_regex = re.escape(slash + path) or r"(?=/|\Z)"
    return Rule(name, verdict, rf"(?:[^/]*\.)?{re.escape(host.lower())}{path_regex}", whole_tokens(parts), "site")


def text_rule(verdict: str, name: str) -> Rule:
    """Text with wildcards, separators and anchors."""
    body = name.lower()
    head = "||" if body.startswith("||") else "|" if body.startswith("|") else ""
    body = body[len(head) :]
    tail = "|" if body.endswith("|") else ""
    body = body.removesuffix(tail)
    signs = {"*": ("(?:.|\n)*", ANY), "^": (_SEPARATOR, EDGE)}
    regex = "".join(signs[c][0] if c in signs else re.escape(c) for c in body)
    parts = [EDGE if head else ANY, *(signs[c][1] if c in signs else c for c in body), EDGE if tail else ANY]
    return Rule(name, verdict, {"||": _HOST_START, "|": "^", "": ""}[head] + regex + (r"\Z" if tail else ""), whole_tokens(parts))


def parse_rule(line: str) -> Rule | None:
    """The rule of a line; None for a blank line or a comment. A line that is no rule raises ValueError."""
    line = line.strip()
    if not line or line.startswith("!"):
        return None
    verdict, name = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
    if len(name) > 2 and name.startswith("/") and name.endswith("/"):
        try:
            return regex_rule(verdict, name, name[1:-1])
        except re.error as e:
            raise ValueError(f"{line}: {e}") from e
    if re.fullmatch(r"\|\|[^/*^|]+(?:/[^*^|]*)?", name):
        return site_rule(verdict, name[2:])
    if not name.strip("|*^"):
        raise ValueError(f"{line}: a rule needs some text")
    return text_rule(verdict, name)


def parse_rules(text: str) -> tuple[Rule, ...]:
    return tuple(r for r in map(parse_rule, text.splitlines()) if r)


# The site rules, net/, example.net/en/, example.com/de/ and org/fr/. Below them the method's own
# patterns, for urls that no site rule fits; the first that is found decides.
RULES = parse_rules(r"""
||net/
@@||example.net/en/
||example.com/de/
@@||org/fr/
! unwanted subjects
/\bspam\b/
/\bpills?\b/
/\bcasino[0-9]*\b/
/\badult\b/
! advertisements and links that are counted
^ads^
/banner/*.gif
?affiliate=
""")
DEFAULT = "allow"


def split_url(url: str | None) -> tuple[str, str]:
    """(host in lower case A-Z, path); both empty without ``://``."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    at = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:at], rest[at:]
    at = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:at]


class RuleIndex:
    """Rules by rarest token."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        rules = list(rules)
        shared = Counter(t for r in rules for t in set(r.tokens))
        self.always: list[tuple[int, Rule]] = []
        self.by: dict[str, list[tuple[int, Rule]]] = defaultdict(list)
        self.compiled: dict[str, re.Pattern] = {}
        for k, r in enumerate(rules):
            home = self.by[min(r.tokens, key=lambda t: (shared[t], -len(t), t))] if r.tokens else self.always
            home.append((k, r))

    def candidates(self, url: str) -> list[tuple[int, Rule]]:
        """(place, rule) of the rules that may fit a lower-cased url."""
        found = list(self.always)
        for t in set(TOKEN.findall(url)):
            found += self.by.get(t, ())
        return found

    def pattern(self, rule: Rule) -> re.Pattern:
        """The rule's expression, compiled when it is first fetched."""
        made = self.compiled.get(rule.regex)
        if made is None:
            made = self.compiled[rule.regex] = re.compile(rule.regex, re.ASCII)
        return made

    def judge(self, url: str | None, default: str = DEFAULT) -> tuple[str, str, str | None, str | None, str]:
        """(host, path, site rule, pattern rule, verdict): the longest site rule that fits (of equals, the first);
        else the first pattern rule; else the default."""
        host, path = split_url(url)
        site, low = host + path, (url or "").lower()
        best = pattern = None
        for k, rule in self.candidates(low):
            if rule.over == "site":
                if host and (best is None or (-len(rule.name), k) < (-len(best[1].name), best[0])) and self.pattern(rule).match(site):
                    best = k, rule
            elif (pattern is None or k < pattern[0]) and self.pattern(rule).search(low):
                pattern = k, rule
        decided = best or pattern
        return host, path, best and best[1].name, pattern and pattern[1].name, decided[1].verdict if decided else default


@lru_cache(maxsize=2)
def _index(rules: tuple[Rule, ...]) -> RuleIndex:
    """One index a worker, whatever its tasks."""
    return RuleIndex(rules)


def judge_urls(pages: DataFrame, rules: Iterable[Rule] = RULES, default: str = DEFAULT) -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, pattern, verdict.

    A null url, or one without ``://``, has an empty host and path and no site rule; patterns are searched in
    any url, whole. Repeated rows stay, null ids are passed on, an empty table gives an empty table; other
    columns are ignored.
    """
    arrow_rows(pages.sparkSession)
    rules = tuple(rules)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _index(rules)
        for pdf in batches:
            made = pd.DataFrame([index.judge(u, default) for u in pdf["url"]], columns=["host", "path", "rule", "pattern", "verdict"], dtype=object)
            made.insert(0, "page_id", pdf["page_id"])
            yield made

    return pages.select(pages["page_id"].cast("string").alias("page_id"), "url").mapInPandas(rows, "page_id string, host string, path string, rule string, pattern string, verdict string").withColumn("page_id", F.col("page_id").cast("long"))


SQL_URLS = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT *, regexp_extract(rest, '^[^/?#]*') AS h0, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), s AS (
  SELECT page_id, coalesce(url, '') AS url, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    CASE WHEN regexp_matches(lower(url), '\bspam\b') THEN '/\bspam\b/' WHEN regexp_matches(lower(url), '\bpills?\b') THEN '/\bpills?\b/'
         WHEN regexp_matches(lower(url), '\bcasino[0-9]*\b') THEN '/\bcasino[0-9]*\b/' WHEN regexp_matches(lower(url), '\badult\b') THEN '/\badult\b/'
         WHEN regexp_matches(lower(url), '(?:[^a-z0-9_.%-]|$)ads(?:[^a-z0-9_.%-]|$)') THEN '^ads^'
         WHEN regexp_matches(lower(url), '/banner/(?:.|\n)*\.gif') THEN '/banner/*.gif' WHEN contains(lower(url), '?affiliate=') THEN '?affiliate=' END AS pattern
  FROM s
)
SELECT page_id, host, path, rule, pattern,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
