"""Near-duplicates by the Jaccard similarity of sets of shingles: SimHash tries, verified, and what they miss.

1. ``simhash.similar_links`` joins the tries of several fingerprints and gives candidate pairs that tie groups of
   near copies together without all of their pairs. Fingerprints only estimate the similarity, so every
   candidate is compared by its shingles before it becomes a link.
2. Fingerprints miss pairs, those of short texts above all. The rest is found by prefixes: the shingles of all
   texts have one order, and two sets of a similarity of at least t share one of the first
   n - ceil(t n) + 1 shingles of each. Two texts that are not tied yet are not both in the largest tied group of
   a shingle that they share, so the texts outside of it are compared with all of that shingle's texts. In the
   order the shingles that a sample of the texts finds in many texts come last, for they tell little; the order
   changes the cost only, never the pairs.

In step 2 a task holds some thousand texts of a shingle as (size, position, parity bits). Each shingle of a set
flips one parity bit, so two sets differ in at least as many shingles as their bits do: pairs that differ too much
never leave the task. While it ties many texts, each text leaves with its most likely partner only; at last with
all that are left. Every link is of two texts whose shingles were compared.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, sized, tidy
from .graph import connected_components
from .simhash import SEED, TABLES, keep_one, prints_of, shingle_hashes, similar_links, with_components

#: One text in SAMPLE is searched for frequent shingles: those of at least OFTEN of these texts, MOST at most.
SAMPLE, OFTEN, MOST = 16, 4, 1 << 18
#: Rows of a shingle in one task, rows of small shingles that share a task, and pairs compared at once.
TILE, PACK, PAIRS = 2048, 4096, 1 << 17
#: Parity bits of a set: as many as its shingles, as a power of two within these bounds.
LEAST_BITS, MOST_BITS = 64, 4096
#: Rounds with single partners go on while they tie one in MANY of the texts outside.
MANY = 8


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles_of(text: str | None, width: int) -> set[bytes]:
    """Shingles of a whole text; of fewer words than ``width`` the whole sequence, of none no shingle."""
    words = _words(text)
    return {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def hashes_of(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    return np.unique(shingle_hashes(text, width))


def parity_bits(h: np.ndarray) -> np.ndarray:
    """Of a set of hashes: bit k is one if an odd number of them fall on it."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, len(h) - 1).bit_length()))
    counts = np.bincount((h >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def ratio(similarity: float) -> tuple[int, int]:
    of = Fraction(similarity).limit_denominator(1000)
    return of.numerator, of.denominator


def is_similar(a: set[bytes], b: set[bytes], p: int, q: int) -> bool:
    both = len(a & b)
    return q * both >= p * (len(a) + len(b) - both)


def prefix_of(h: np.ndarray, p: int, q: int, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a sorted set by (rank, hash), in that order; none if no other set can be similar."""
    n = len(h)
    # the most similar other set has one shingle more
    if q * n < p * (n + 1):
        return h[:0]
    keys, ranks = often
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        h = h[np.lexsort((h, np.where(keys[at] == h, ranks[at], 0)))]
    return h[: n + (-p * n) // q + 1]


def _often(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ranks) of frequent shingles: the more frequent, the higher."""

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([hashes_of(t, width).view(np.int64) for t in texts], dtype=object)

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = some.select(F.explode(hashes("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    counts, least = materialize(counts.where(F.col("c") >= OFTEN), "near-often"), OFTEN
    while counts.where(F.col("c") >= least).count() > MOST:
        least *= 2
    found = counts.where(F.col("c") >= least).toArrow()
    keys, c = found["token"].to_numpy().view(np.uint64), found["c"].to_numpy()
    at = np.argsort(keys)
    return keys[at], np.frexp(c[at].astype(np.float64))[1].astype(np.int16)


def shingle_sets(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id, text_hash, fp: names a set of shingles, n: its size, prefix, bits: parity bits, fps: SimHash
    fingerprints) of every row of docs (doc_id, text)."""
    spark, (p, q) = docs.sparkSession, ratio(similarity)
    arrow_rows(spark)
    often = spark.sparkContext.broadcast(_often(docs, width))
    tidy(spark)

    @F.pandas_udf("fp long, n long, prefix array<long>, bits binary, fps array<long>")
    def sets(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            every = shingle_hashes(t, width)
            h = np.unique(every)
            name = np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).view(np.int64)
            out.append((name, len(h), prefix_of(h, p, q, often.value).view(np.int64), parity_bits(h).tobytes(), prints_of(every, TABLES).view(np.int64)))
        return pd.DataFrame(out, columns=["fp", "n", "prefix", "bits", "fps"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), sets("text").alias("s"))
    return materialize(rows.select("doc_id", "text_hash", "s.*"), "near-docs")


def similar_sets(docs: DataFrame, sets: DataFrame, width: int, similarity: float) -> DataFrame:
    """(node, root): the components of the sets (``shingle_sets`` of docs) under the pairs of ``similarity`` or more;
    sets without such a pair are left out. Sets are tied by pairs only whose shingles were compared, and every pair
    that is similar is tied."""
    p, q = ratio(similarity)
    col, names = F.col, sets.select("fp", "text_hash")
    nodes = materialize(sets.where("size(prefix) > 0").drop("doc_id", "text_hash").dropDuplicates(["fp"]), "near-sets")
    done = materialize(_ordered(similar_links(nodes.select("fp", "n", "fps"), similarity)), "near-seeds")
    roots = materialize(connected_components(_verified(done, docs, names, width, p, q)), "near-roots")

    flat = nodes.select("fp", F.posexplode("prefix").alias("pos", "token"))
    shared = flat.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rows = materialize(flat.join(shared, "token", "left_semi"), "near-shared")
    last = False
    while True:
        tidy(docs.sparkSession)
        tied = rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        groups = tied.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"))
        most = groups.groupBy("token").agg(F.max(F.struct("k", "root")).alias("most"), F.sum("k").alias("all")).where(col("most.k") < col("all"))
        most = most.select("token", "all", col("most.root").alias("most"), (col("all") - col("most.k")).alias("n_out"))
        # what is tied whole stays so
        tied = materialize(tied.join(most, "token").withColumn("out", col("root") != col("most")).drop("most"), "near-tied")
        rows = tied.select("token", "fp", "pos")
        size, out = tied.agg(F.count(F.lit(1)), F.count_distinct(F.when(col("out"), col("fp")))).first()
        if not out:
            return roots
        fresh = _candidates(tied, nodes.select("fp", "n", "bits"), p, q, last, max(1, -(-size // PACK)))
        fresh = materialize(_ordered(fresh).join(done, ["a", "b"], "left_anti"), "near-candidates")
        more = _verified(fresh, docs, names, width, p, q)
        # the roots stand for all links so far
        roots = materialize(connected_components(roots.toDF("a", "b").union(more)), "near-roots")
        if last:
            return roots
        done, last = done.union(fresh), more.count() < out / MANY


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _candidates(tied: DataFrame, nodes: DataFrame, p: int, q: int, every: bool, packs: int) -> DataFrame:
    """Pairs (a, b) of sets that share a token of tied (token, fp, pos, root, out, all: the token's rows, n_out: those
    that are ``out``), are of two roots, one of them out, and may be similar by size, positions and parity bits (nodes:
    fp, n, bits). Unless ``every``, of each set that is out the likeliest partner only.

    A token of over ``TILE`` rows is compared in tiles: each block of its rows that are out with each block of
    all. Smaller tokens share ``packs`` tasks."""
    col, one = F.col, F.lit(1).cast("long")
    spread = F.xxhash64("fp", F.lit(7))
    blocks, outer = F.greatest(one, F.ceil(col("all") / TILE)), F.greatest(one, F.ceil(col("n_out") / TILE))
    rows = tied.join(nodes, "fp").withColumns({"blocks": blocks, "outer": outer})
    small = rows.where("blocks = 1").withColumns({"pack": F.pmod(F.xxhash64("token"), F.lit(packs)), "i": F.lit(0).cast("long"), "target": F.lit(True), "probe": col("out")})
    every_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), col(n) - 1))
    large = rows.where("blocks > 1")
    targets = large.withColumns({"pack": F.pmod(spread, col("blocks")), "i": every_of("outer"), "target": F.lit(True), "probe": F.lit(False)})
    probes = large.where("out").withColumns({"i": F.pmod(spread, col("outer")), "pack": every_of("blocks"), "target": F.lit(False), "probe": F.lit(True)})
    names = ["token", "fp", "n", "pos", "root", "out", "bits", "pack", "i", "target", "probe"]
    dealt = small.withColumn("big", F.lit(None).cast("long")).select(*names, "big")
    for part in (targets, probes):
        dealt = dealt.unionByName(part.withColumn("big", col("token")).select(*names, "big"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return _compare(pdf, p, q, every)

    found = dealt.groupBy("big", "pack", "i").applyInPandas(compare, "a long, b long, score double")
    if every:
        return found.select("a", "b")
    return found.groupBy("a").agg(F.max_by("b", F.struct("score", "b")).alias("b"))


def _compare(pdf: pd.DataFrame, p: int, q: int, every: bool) -> pd.DataFrame:
    """The pairs of probes (a) and targets (b) of one token each that may be similar, with their score."""
    pdf = pdf.sort_values("token", kind="stable")
    token, fp, n, pos, root = (pdf[c].to_numpy(np.int64) for c in ("token", "fp", "n", "pos", "root"))
    out, bits = pdf["out"].to_numpy(bool), pdf["bits"].to_numpy()
    probes, targets = (np.flatnonzero(pdf[c].to_numpy(bool)) for c in ("probe", "target"))
    begin, end = (np.searchsorted(token[targets], token[probes], side) for side in ("left", "right"))
    words = np.array([len(x) // 8 for x in bits], np.int64)
    level = {w: np.flatnonzero((words == w) | (words == 2 * w)) for w in np.unique(words).tolist()}
    folded = {}
    for w, at in level.items():
        made = np.zeros((len(at), w), np.uint64)
        for k, r in enumerate(at.tolist()):
            x = np.frombuffer(bits[r], np.uint64)
            # the bit of a hash is its high bits, so halves of a size are neighbours of the double size
            made[k] = x if len(x) == w else _fold(x)
        folded[w] = made, at
    sizes, found = end - begin, []
    stops = np.searchsorted(np.cumsum(sizes), np.arange(PAIRS, int(sizes.sum()) + PAIRS, PAIRS)) + 1
    first = 0
    for stop in np.minimum(stops, len(probes)).tolist():
        if stop <= first:
            continue
        some, first = np.arange(first, stop), stop
        of = np.repeat(some, sizes[some])
        j = targets[begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])]
        i = probes[of]
        both = n[i] + n[j]
        may = (root[i] != root[j]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) * (p + q) >= both * p)
        if every:  # two sets that are both out meet twice
            may &= ~out[j] | (fp[i] < fp[j])
        i, j, both = i[may], j[may], both[may]
        differ = np.full(len(i), np.iinfo(np.int64).max)
        pair = np.minimum(words[i], words[j])
        for w, (made, at) in folded.items():
            x = np.flatnonzero((pair == w) & (np.maximum(words[i], words[j]) <= 2 * w))
            if len(x):
                differ[x] = np.bitwise_count(made[np.searchsorted(at, i[x])] ^ made[np.searchsorted(at, j[x])]).sum(1, dtype=np.int64)
        # sets whose sizes are within the similarity have bits of one size or of the next
        near = differ * (p + q) <= both * (q - p)
        i, j, score = i[near], j[near], -differ[near] / both[near]
        if not every and len(i):
            best = np.lexsort((j, -score, i))
            best = best[np.unique(i[best], return_index=True)[1]]
            i, j, score = i[best], j[best], score[best]
        found.append(pd.DataFrame({"a": fp[i], "b": fp[j], "score": score}))
    return pd.concat(found) if found else pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "score": np.empty(0)})


def _fold(x: np.ndarray) -> np.ndarray:
    """Parity bits of half the size: neighbouring bits added."""
    pairs = np.unpackbits(x.view(np.uint8), bitorder="little").reshape(-1, 2)
    return np.packbits(pairs[:, 0] ^ pairs[:, 1], bitorder="little").view(np.uint64)


def similar_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text_hash, fp, component_id, component. Sets of shingles link
    at ``similarity`` or more. Null and empty texts are one set; rows and ids are as in ``simhash_classes``."""
    sets = shingle_sets(docs, width, similarity)
    prints = sets.select("doc_id", "text_hash", "fp")
    roots = similar_sets(docs, sets, width, similarity)
    return with_components(prints, roots)


def similar_dedup(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component of ``similar_classes``: see ``keep_one``."""
    return keep_one(docs, similar_classes(docs, width, similarity))


def _verified(pairs: DataFrame, docs: DataFrame, names: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """The pairs (a, b) of sets (fp) that are similar by the shingles of a text of each."""
    tidy(docs.sparkSession)

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([is_similar(shingles_of(s, width), shingles_of(t, width), p, q) for s, t in zip(x, y)], dtype=bool)

    used = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    used = materialize(names.join(used, "fp").groupBy("fp").agg(F.min("text_hash").alias("text_hash")), "near-names")
    texts = docs.select("text", F.xxhash64("text").alias("text_hash")).join(sized(used, 24), "text_hash")
    texts = materialize(texts.dropDuplicates(["fp"]).select("fp", "text"), "near-texts")
    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    return materialize(both.where(near("x", "y")).select("a", "b"), "near-links")
