"""Secret scans: fixed patterns, and Shannon entropy of sliding windows over candidate strings.

Spans are in code points, end exclusive, of the whole match. Kinds: ``assign``, ``access`` and ``hex`` are
the base patterns (leftmost, non-overlapping within a kind). ``entropy`` spans are added where no base span
lies: candidates are runs of at least ``WINDOW`` characters of one alphabet, without the base spans in them. A
window of ``WINDOW`` characters slides over them; the counts of its characters and the number of its
lower-case letters, upper-case letters, digits and symbols are kept up step by step. A window whose entropy
reaches the limit of its own character class is dense, and dense windows that overlap make up a span.
Allow-listed candidates are suppressed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

# The base patterns and their least lengths.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 12
# A run of the greedy pattern that is long enough is found just as well with its least length in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
BASE_KINDS = ("assign", "access", "hex")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Least entropy (bits) of a window, by the class of its characters. Random windows of a class lie above with few
#: exceptions, words, identifiers and paths below (tests/llm measures both); several words run together in lower case may reach it. Digits alone are base spans.
LIMITS = {"hex": 3.0, "lower": 3.65, "letter": 3.85, "alnum": 3.7, "mark": 4.0, "symbol": 3.9}
#: A candidate with one of these as a whole part (between characters that are no letters or digits) is no secret.
ALLOW_WORDS = frozenset(("example", "sample", "dummy", "placeholder", "changeme", "lorem", "test"))
#: Nor is one that one of these is found in.
ALLOW = tuple(
    re.compile(p)
    for p in (
        r"(?i)abcdefgh|01234567|12345678|qwerty",
        r"(.)\1{7,}",
        r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
        # words and numbers between marks, and identifiers of words that begin with a capital
        r"^[-_/=]*(?:[a-z]{1,15}|[A-Z]{1,15}|[A-Z][a-z]{1,14}|[0-9]{1,8}|v[0-9]{1,3})(?:[-_/=]+(?:[a-z]{1,15}|[A-Z]{1,15}|[A-Z][a-z]{1,14}|[0-9]{1,8}|v[0-9]{1,3}))+[-_/=]*$",
        r"^[A-Z]?[a-z]{2,15}(?:[A-Z][a-z]{2,15})+[0-9]{0,4}$",
        r"^[-_=+/]*$",
    )
)
_PARTS = re.compile(r"[A-Za-z0-9]+")


def _kind(c: str) -> int:
    """0: a-f, 1: other lower case, 2: A-F, 3: other upper case, 4: digit, 5: symbol."""
    if c.islower():
        return 0 if c <= "f" else 1
    if c.isupper():
        return 2 if c <= "F" else 3
    return 4 if c.isdigit() else 5


def window_class(kinds: list[int]) -> str:
    """The class of a window with so many characters of each ``_kind``."""
    af, lower, up_af, upper, digits, symbols = kinds
    if symbols:
        return "symbol" if digits else "mark"
    if not digits:
        return "letter" if up_af + upper else "lower"
    return "hex" if not lower + upper and not (af and up_af) else "alnum"


def dense_spans(s: str, limits: dict[str, float] = LIMITS, window: int = WINDOW) -> list[tuple[int, int]]:
    """The runs of overlapping windows of s whose entropy reaches the limit of their class.

    The sum of c*log2(c) over the counts c in the window follows each step by one character out, one in."""
    log = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    need = {k: (math.log2(window) - limit) * window + 1e-9 for k, limit in limits.items()}
    counts: dict[str, int] = {}
    kinds, total = [0] * 6, 0.0
    found: list[tuple[int, int]] = []
    for k, c in enumerate(s):
        if k >= window:
            out = s[k - window]
            n = counts[out]
            total += log[n - 1] - log[n]
            counts[out] = n - 1
            kinds[_kind(out)] -= 1
        n = counts.get(c, 0)
        total += log[n + 1] - log[n]
        counts[c] = n + 1
        kinds[_kind(c)] += 1
        if k >= window - 1 and total <= need[window_class(kinds)]:
            begin = k - window + 1
            if found and begin < found[-1][1]:
                found[-1] = (found[-1][0], k + 1)
            else:
                found.append((begin, k + 1))
    return found


def is_allowed(s: str) -> bool:
    return any(p.search(s) for p in ALLOW) or any(x.lower() in ALLOW_WORDS for x in _PARTS.findall(s))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], BASE_KINDS.index(x[2]), x[1]))


def entropy_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    found = []
    for m in CANDIDATE.finditer(text):
        if is_allowed(m[0]):
            continue
        # the candidate without its base spans (sorted by start)
        pieces, at = [], m.start()
        for x, y, _ in base:
            if x < m.end() and y > at:
                pieces.append((at, x))
                at = max(at, y)
        for x, y in (*pieces, (at, m.end())):
            if y - x >= WINDOW:
                found += [(x + i, x + j, "entropy") for i, j in dense_spans(text[x:y])]
    return found


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, added spans) of a whole text; a null text has none."""
    base = base_spans(text or "")
    return base, entropy_spans(text or "", base)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    Null and empty texts have no span (the digest of the empty string). Repeated rows stay, null ids are
    passed on, an empty table gives an empty table; other columns are ignored.
    """
    arrow_rows(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                base, more = scan(text)
                kinds = [k for _, _, k in base]
                plain = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
                both = sorted(base + more, key=lambda x: (x[0], (*BASE_KINDS, "entropy").index(x[2]), x[1]))
                out.append((*(kinds.count(k) for k in BASE_KINDS), len(more), hashlib.sha256(plain.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, b, k in both)))
            made = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])
            made.insert(0, "doc_id", pdf["doc_id"])
            yield made

    return docs.select(docs["doc_id"].cast("string").alias("doc_id"), "text").mapInPandas(rows, "doc_id string, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string").withColumn("doc_id", F.col("doc_id").cast("long"))
