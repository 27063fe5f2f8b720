"""The exact similarity join of the pipeline against plain Jaccard over all pairs."""

import random

import numpy as np

import corpus_pipeline
from tesserae.llm import jaccard
from tesserae.llm.common import table

from test_llm import WORD, odd_rows


def plain_sets(text, width=5):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def plain_kept(rows):
    """The least doc_id of each component of texts at a Jaccard similarity of 0.8 or more."""
    sets = [plain_sets(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if 5 * len(x & y) >= 4 * len(x | y):
                label[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        low[r] = i if low.get(r) is None else low[r] if i is None else min(i, low[r])
    return sorted(low.values(), key=repr)


def kept(spark, df):
    return sorted((r.doc_id for r in corpus_pipeline.one_of_each_group(spark, df, "").collect()), key=repr)


def test_stage_equals_plain_jaccard(spark, sf):
    odd = spark.createDataFrame([r[:3] for r in odd_rows()], "doc_id long, text string, source string")
    for df in (table(spark, sf, "documents").select("doc_id", "text"), odd):
        assert kept(spark, df) == plain_kept([(r.doc_id, r.text) for r in df.collect()])
    assert kept(spark, odd.limit(0)) == []


def test_around_the_limit(spark, seed=1):
    """Short texts and the same text plus a word (0.8 and above), and texts edited so that they lie on both sides."""
    rng, texts = random.Random(seed), []
    for size in (6, 7, 8, 9, 10, 12, 20, 24, 29, 60, 200):
        for _ in range(8):
            words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            more = list(words)
            for k in rng.sample(range(size), max(1, size // rng.choice([30, 40, 50, 100]))):
                more[k] = f"new{rng.randrange(10**6)}"
            texts += [" ".join(words), " ".join(words + ["more"]), " ".join(more), " ".join(words * 2)]
    rows = list(enumerate(texts))
    assert kept(spark, spark.createDataFrame(rows, "doc_id long, text string")) == plain_kept(rows)


def test_frequent_line_and_dense_group(spark, monkeypatch):
    """A line in most texts, a chain of near copies, and near copies of texts under that line."""
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    rng = random.Random(3)
    line = [f"c{k}" for k in range(30)]
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [line + own(rng.choice([4, 6, 10, 30, 90])) for _ in range(150)]
    chain = own(80)
    for k in range(80):
        chain = chain[:k] + [f"n{k}"] + chain[k + 1 :]
        texts.append(chain)
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(spark, docs) == plain_kept(rows)
    monkeypatch.setattr(jaccard, "MOST", 3)
    assert kept(spark, docs) == plain_kept(rows)


def test_prefixes_share_a_shingle():
    """Two sets at the limit share a shingle of their prefixes in any order."""
    rng = np.random.default_rng(4)
    for _ in range(2000):
        n = int(rng.integers(1, 60))
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
        both, a, b = (int(rng.integers(1, n + 1)), *rng.integers(0, 1 + n // 6, 2).tolist())
        x, y = np.sort(pool[: both + a]), np.sort(np.append(pool[:both], pool[both + a : both + a + b]))
        often = np.sort(rng.choice(pool, len(pool) // 3, replace=False)), rng.integers(1, 4, len(pool) // 3).astype(np.int16)
        if 5 * both >= 4 * len(np.union1d(x, y)) and len(np.union1d(x, y)) > both:
            assert len(np.intersect1d(jaccard.prefix_of(x, 4, 5, often), jaccard.prefix_of(y, 4, 5, often)))
