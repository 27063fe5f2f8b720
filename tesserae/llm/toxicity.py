"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, its white space collapsed to single spaces and one space put at either end. Its
features are the sets of its n-grams of ``lengths`` code points, wherever they lie in the text. From a
sample of labelled rows come, for each n-gram, the log ratio r of its (smoothed, normalised) document
counts in the toxic and the other class; the ``vocabulary`` n-grams that tell the classes apart best (by
chi-square) are kept, and a logistic regression with L2 penalty is fitted to presence times r.

Bounds: the sample has at most ``per_class`` labelled rows of each class, chosen by the hash of their id; the driver
holds the indices of their known n-grams, 20,000 at most of 4 bytes each (400 MB at worst, some 10 MB as measured).
Everything else covers all rows and whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, sized, tidy, trim

LENGTHS = (3, 4, 5, 6)
PER_CLASS, VOCABULARY, LEAST_DF = 2500, 20_000, 4
FOLDS, HELD_OUT = 5, 0
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PIECE = 1 << 18
_TABLE_BITS = 21


def grams(text: str | None, lengths: tuple[int, ...] = LENGTHS) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a text, in pieces (repeats included)."""
    text = f" {' '.join((text or '').lower().split())} "
    most = max(lengths)
    for k in range(0, max(1, len(text) - 1), _PIECE):
        piece = text[k : k + _PIECE + most - 1]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = codes
        for n in range(2, most + 1):
            if len(codes) < n:
                break
            h = h[: len(codes) - n + 1] * _BASE + codes[n - 1 :]
            if n in lengths:
                own = (h + np.uint64(n)) * _MIX
                # the piece's tail is there for n-grams that begin in the piece
                yield (own ^ (own >> np.uint64(31))) * _BASE if k + _PIECE >= len(text) else ((own ^ (own >> np.uint64(31))) * _BASE)[:_PIECE]


def distinct_grams(text: str | None, lengths: tuple[int, ...] = LENGTHS) -> np.ndarray:
    parts = [np.unique(h) for h in grams(text, lengths)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


@dataclass
class Model:
    """A fitted classifier. ``hashes`` is sorted; ``weights`` are the coefficients times r."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    lengths: tuple[int, ...] = LENGTHS
    _seen: np.ndarray | None = field(default=None, repr=False)

    def present(self, text: str | None) -> np.ndarray:
        """Indices of the model's n-grams that occur in the whole text."""
        if not len(self.hashes):
            return np.empty(0, np.int64)
        shift = np.uint64(64 - _TABLE_BITS)
        if self._seen is None:
            self._seen = np.zeros(1 << _TABLE_BITS, bool)
            self._seen[self.hashes >> shift] = True
        found = []
        for h in grams(text, self.lengths):
            h = h[self._seen[h >> shift]]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            found.append(at[self.hashes[at] == h])
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[self.present(text)].sum())
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, z))))


def _logistic(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, l2: float, steps: int = 60) -> tuple[np.ndarray, float]:
    """L-BFGS for the logistic loss of the sparse 0/1 rows times r, with an L2 penalty on the weights."""
    m, n = len(r), len(rows)
    sizes = np.array([len(x) for x in rows])
    cuts = np.append(np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), 1 << 20)), n)
    blocks = [(a, b, np.concatenate(rows[a:b]), np.repeat(np.arange(b - a, dtype=np.int32), sizes[a:b])) for a, b in zip(cuts, cuts[1:]) if b > a]

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        scaled, loss, g, rest = w[:m] * r, 0.0, np.zeros(m), 0.0
        for a, b, cols, of in blocks:  # a million entries at a time
            z = np.bincount(of, scaled[cols], b - a) + w[m]
            loss += float((np.logaddexp(0, z) - y[a:b] * z).sum())
            e = 1 / (1 + np.exp(-np.clip(z, -700, 700))) - y[a:b]
            g += np.bincount(cols, e[of], m)
            rest += e.sum()
        return loss / n + l2 / 2 * float(w[:m] @ w[:m]), np.append(g * r / n + l2 * w[:m], rest / n)

    w = np.zeros(m + 1)
    f, g = value(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, alphas = -g, []
        for s, t, rho in reversed(past):
            alphas.append(a := rho * (s @ d))
            d = d - a * t
        if past:
            s, t, rho = past[-1]
            d = d / (rho * (t @ t))
        for (s, t, rho), a in zip(past, reversed(alphas)):
            d = d + (a - rho * (t @ d)) * s
        step = 1.0 if past else 1 / max(1e-12, np.abs(g).sum())
        while step > 1e-10:
            f2, g2 = value(w + step * d)
            if f2 <= f + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        s, t = step * d, g2 - g
        if (c := s @ t) > 1e-12:
            past = [*past[-9:], (s, t, 1 / c)]
        done = abs(f - f2) < 1e-7
        w, f, g = w + s, f2, g2
        if done:
            break
    return w[:m] * r, float(w[m])


def is_held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves remainder 0 modulo 5 (a null id: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(text, label) of at most 2 * per_class labelled rows outside the held-out fold. Rows without id or
    label are left out; of several labels of one id the larger counts, of several texts the least."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~is_held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("label = 1").orderBy(*order).limit(per_class).unionByName(known.where("label = 0").orderBy(*order).limit(per_class))
    chosen = materialize(chosen, "tox-ids")
    rows = docs.select("doc_id", "text").join(sized(chosen, 16), "doc_id")
    return rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text")).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, lengths: tuple[int, ...] = LENGTHS, per_class: int = PER_CLASS, vocabulary: int = VOCABULARY, least_df: int = LEAST_DF, l2: float = 1e-3) -> Model:
    """Fits the classifier on a bounded sample of labelled rows.

    Without both classes there is nothing to tell apart: the model then gives every text the share of
    label 1 (0 without any label).
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    sample = materialize(training_sample(docs, labels, per_class).repartition(12), "tox-sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        share = pos / max(1, pos + neg)
        return Model(np.empty(0, np.uint64), np.empty(0), 700.0 if share else -700.0, lengths)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {0: [], 1: []}
        h, p, q = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)

        def fold() -> None:
            nonlocal h, p, q
            parts = [h, *held[1], *held[0]]
            ones = [p, *(np.ones(len(x), np.int32) for x in held[1]), *(np.zeros(len(x), np.int32) for x in held[0])]
            zeros = [q, *(np.zeros(len(x), np.int32) for x in held[1]), *(np.ones(len(x), np.int32) for x in held[0])]
            keys, of = np.unique(np.concatenate(parts), return_inverse=True)
            p, q = (np.bincount(of, np.concatenate(x), len(keys)).astype(np.int32) for x in (ones, zeros))
            h = keys
            held[0].clear()
            held[1].clear()

        waiting = 0
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"]):
                held[int(label)].append(x := distinct_grams(text, lengths))
                waiting += len(x)
                if waiting > 500_000:
                    fold()
                    waiting = 0
        fold()
        for k in range(0, len(h), 1 << 16):
            cut = slice(k, k + (1 << 16))
            yield pd.DataFrame({"h": h[cut].view(np.int64), "p": p[cut], "q": q[cut]})
        del h, p, q
        trim()

    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    chi = F.pow(p * neg - q * pos, 2) / ((p + q) * (pos + neg - p - q + 1))
    table = sample.mapInPandas(counts, "h long, p int, q int").groupBy("h").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    table = table.where(F.col("p") + F.col("q") >= min(least_df, pos)).orderBy(chi.desc(), "h").limit(vocabulary)
    got = table.toPandas()
    hashes = got["h"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(hashes)
    hashes, np_, nq = hashes[at], got["p"].to_numpy(float)[at] + 1, got["q"].to_numpy(float)[at] + 1
    ratio = np.log(np_ / np_.sum()) - np.log(nq / nq.sum())
    model = Model(hashes, ratio, 0.0, lengths)
    seen = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"label": pdf["label"], "at": [seen.value.present(t).astype(np.int32).tobytes() for t in pdf["text"]]})

    matrix = sample.mapInPandas(rows, "label int, at binary").toPandas()
    x = [np.frombuffer(b, np.int32) for b in matrix["at"]]
    weights, bias = _logistic(x, matrix["label"].to_numpy(float), ratio, l2)
    del x, matrix
    tidy(spark)
    return Model(hashes, weights, bias, lengths)


def scorer(docs: DataFrame, model: Model):
    """A column function: text -> score."""
    arrow_rows(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([held.value.score(t) for t in texts], dtype="float64")

    return score


def toxicity_scores(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text); other columns are ignored.

    A null text counts as empty; an empty text has the score of a text without any known n-gram. Repeated
    rows stay; rows without an id count as not held out. An empty table gives an empty table.
    """
    score = scorer(docs, model)
    out = docs.select("doc_id", is_held_out().alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that the model calls toxic; all columns stay. Null and empty texts are scored as in
    ``toxicity_scores``; repeated rows share their fate; an empty table gives an empty table."""
    return docs.where(scorer(docs, model)(docs["text"]) < threshold)
