"""Token counts by section, attributed through the tokens' character offsets.

A document is encoded once, whole. Byte-level tokens partition its UTF-8 bytes, so the running sum of
their byte lengths gives each token's span, and the count of lead bytes turns it into characters. Sections
are character intervals that cover the document; the spans are joined to them as intervals.

Rule for a token that crosses a boundary: it goes, whole, to the section that holds most of its bytes; on
a tie, to the earlier one. So the counts of a document's sections sum to its tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows


@lru_cache(maxsize=2)
def encoding(path: str):
    """(tiktoken encoding without special tokens, byte length of each id)."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        lengths[k] = len(token)
    return tiktoken.Encoding("sections", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def line_sections(text: str) -> np.ndarray:
    """Character starts of the sections: the lines, each with its line feed."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.flatnonzero(codes[:-1] == 10) + 1 if len(codes) else np.empty(0, np.int64)
    return np.concatenate([[0], starts])


def attribute(raw: bytes, lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sections that begin at the characters ``starts``: their tokens, the tokens that touch them and
    another section, and their ends in characters. raw: the text's UTF-8; lengths: bytes of each token."""
    data = np.frombuffer(raw, np.uint8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    begins = np.concatenate([lead, [len(data)]])[starts]  # byte starts of the sections
    ends = np.append(begins[1:], len(data))
    last = np.cumsum(lengths)
    first = last - lengths
    a = np.searchsorted(begins, first, "right") - 1  # the section of a token's first byte
    b = np.searchsorted(begins, last - 1, "right") - 1  # and of its last
    home = a.copy()
    crossing = np.zeros(len(starts), np.int64)
    for t in np.flatnonzero(a != b).tolist():
        over = [min(last[t], ends[s]) - max(first[t], begins[s]) for s in range(a[t], b[t] + 1)]
        home[t] = a[t] + int(np.argmax(over))
        crossing[a[t] : b[t] + 1] += 1
    return np.bincount(home, minlength=len(starts)), crossing, np.append(starts[1:], len(lead))


def section_tokens(docs: DataFrame, tokenizer_path: str, sections=line_sections) -> DataFrame:
    """One row per section of each row of docs (doc_id, text): doc_id, section, start_char, end_char,
    n_tokens, n_crossing (tokens that lie here and in another section too), doc_tokens.

    A null or empty text has one empty section with no tokens. Repeated rows are repeated, null ids are
    passed on, an empty table gives an empty table; other columns are ignored.
    """
    arrow_rows(docs.sparkSession, 256)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, size = encoding(tokenizer_path)
        for pdf in batches:
            parts = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                text = text or ""
                lengths = size[enc.encode_ordinary(text)] if text else np.empty(0, np.int64)
                starts = sections(text)
                n, crossing, ends = attribute(text.encode(), lengths, starts)
                k = len(starts)
                parts.append(pd.DataFrame({"doc_id": [doc_id] * k, "section": np.arange(k), "start_char": starts, "end_char": ends, "n_tokens": n, "n_crossing": crossing, "doc_tokens": np.full(k, len(lengths))}))
            if parts:
                yield pd.concat(parts)

    return docs.select(docs["doc_id"].cast("string").alias("doc_id"), "text").mapInPandas(rows, "doc_id string, section long, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long").withColumn("doc_id", F.col("doc_id").cast("long"))
