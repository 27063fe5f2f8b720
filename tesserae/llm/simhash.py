"""SimHash near-duplicates: 64-bit fingerprints, linked by a self-join of their binary trie.

Fingerprint: bytes of the text with A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of
``width`` words joined by a space (repeats count; fewer words: the whole sequence), XXH64 with a seed.
A bit is one if it is set in over half of the hashes. A null or empty text has fingerprint zero and is
linked like any other.

Self-join: the trie branches on the bits in order of balance (the bit whose ones are nearest to half of
the fingerprints first). Its top ``depth`` levels are cut into node pairs whose prefixes differ in at
most ``radius`` bits; each pair is one task, in which the pair's subtrees are traversed together. The
differing bits add up on the way down, and a pair is left as soon as they exceed the radius. A task
returns a spanning forest of the links that it found, so a dense group makes no more rows than it has
fingerprints; a node pair whose keys are already in one component is left too, so a dense group does not
cost all of its pairs. A node pair that a dense group makes too large for one task is tiled: see ``_tiled``.

``similar_links`` looks for a similarity of shingles instead of a radius, for ``jaccard``, which verifies what it
finds and completes it. One fingerprint is too short for that, so a text has ``TABLES`` of them. Each is the key
of one trie, whose error budget counts only its top ``TOP`` bits; the differing bits of all fingerprints
together estimate the similarity of the pairs it finds. Only texts of like length can be similar, so each trie
holds one window of lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, join_groups, materialize, sized
from .graph import connected_components

SEED, BITS = 42, 64
#: Fingerprints under one trie node of a task, on average, and the least depth of the cut.
NODE_SIZE, MIN_DEPTH = 1 << 17, 4
#: A node pair of more rows than this many nodes is tiled.
LARGE = 4
#: Rows of a block of node pairs; leaves of so few pairs are compared directly.
BLOCK, LEAF = 1 << 17, 16
#: Fingerprints of a text in ``similar_links``, each the key of a trie, the bits of a key that count, and their radius.
TABLES, TOP, RADIUS = 4, 24, 3
#: Rows of a node there, on average; a node of more is cut into blocks of this size.
SIMILAR_NODE = 1 << 13
#: Hashes counted at once: ``_RUN`` bits add up in a byte.
_RUN = 255
_SLICE = _RUN << 6


def shingle_hashes(text: str | None, width: int, seed: int = SEED) -> np.ndarray:
    """Hashes of the shingles of a whole text, repeats included, in their order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = ends[min(width, len(words)) - 1 :]
    digest, out = xxhash.xxh64_intdigest, np.empty(n, np.uint64)
    for k in range(0, n, _SLICE):
        a, b = starts[k : min(k + _SLICE, n)].tolist(), last[k : k + _SLICE].tolist()
        out[k : k + len(a)] = np.fromiter((digest(joined[i:j], seed) for i, j in zip(a, b)), np.uint64, len(a))
    return out


def prints_of(hashes: np.ndarray, tables: int = 1) -> np.ndarray:
    """Unsigned fingerprints of a text's shingle hashes. The first is by the hashes themselves, each further one by
    another bijective mix of them."""
    n = len(hashes)
    if not n:
        return np.zeros(tables, np.uint64)
    ones = np.zeros((tables, BITS), np.int64)
    steps = np.array([t * 0x9E3779B97F4A7C15 % 2**64 for t in range(tables)], np.uint64)[:, None]
    for k in range(0, n, _SLICE):
        part = hashes[k : k + _SLICE]
        runs = -(-len(part) // _RUN)
        h = np.zeros((tables, runs * min(_RUN, len(part))), np.uint64)
        h[0, : len(part)] = part
        if tables > 1:
            mixed = part + steps[1:]
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h[1:, : len(part)] = mixed ^ (mixed >> np.uint64(31))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1), bitorder="little").reshape(tables, runs, -1, BITS)
        ones += bits.sum(2, dtype=np.uint8).sum(1, dtype=np.int64)
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    return int(prints_of(shingle_hashes(text, width, seed))[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp: signed long) of every row; text_hash tells rows of one id apart."""
    arrow_rows(docs.sparkSession)

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), prints("text").alias("fp"))


def _links(keys: np.ndarray, split: int, radius: int, top: int = BITS, wide: np.ndarray | None = None, limit: int = 0) -> np.ndarray:
    """Links (i, j) that span the components among keys (sorted uint64; the first ``split`` are node a, the rest
    node b; split 0: one node joined with itself); stars (node, root). Of the keys only the ``top`` bits count.
    With ``wide``, rows of further fingerprints, a link also needs at most ``limit`` differing bits among all of
    those, and is a pair that was compared."""
    n, stars = len(keys), wide is None
    zeros: dict[int, np.ndarray] = {}
    root, run = np.arange(n), np.arange(1, n + 1)
    found: list[np.ndarray] = []
    fresh = 0

    def below(bit: int) -> np.ndarray:
        """At i: how many of the first i keys have a zero there."""
        if bit not in zeros:
            zeros[bit] = np.concatenate([[0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1) == 0)]).astype(np.int32)
        return zeros[bit]

    def test(i: np.ndarray, j: np.ndarray) -> None:
        """Adds those of the pairs that are linked, but not if they are in one component already."""
        nonlocal fresh
        at = np.flatnonzero((i < j) & (np.bitwise_count((keys[i] ^ keys[j]) >> np.uint64(BITS - top)) <= radius) & (root[i] != root[j]))
        for k in range(0, len(at), BLOCK):
            a, b = i[at[k : k + BLOCK]], j[at[k : k + BLOCK]]
            if wide is not None:
                near = np.bitwise_count(wide[a] ^ wide[b]).sum(1, dtype=np.int32) <= limit
                a, b = a[near], b[near]
            if len(a):
                found.append(np.stack([a, b], 1))
                fresh += len(a)
        if fresh > max(4096, n >> 3):
            settle()

    def settle() -> None:
        """Folds the links into a forest; run[i] is where the keys of i's component that follow i on end."""
        nonlocal fresh, found
        fresh = 0
        if found:
            forest = _forest(np.concatenate(found), n)
            found = [forest if stars else _spanning(np.concatenate(found), n)]
            root[forest[:, 0]] = forest[:, 1]
            root[forest[:, 1]] = forest[:, 1]
            cuts = np.flatnonzero(root[1:] != root[:-1]) + 1
            run[:] = np.append(cuts, n)[np.searchsorted(cuts, np.arange(n), "right")]

    for step in (1, 2, 3):
        test(np.arange(max(0, n - step)), np.arange(step, max(step, n)))
    settle()
    stack = [(BITS - 1, np.array([[0, split, split, n, 0] if split else [0, n, 0, n, 0]], np.int32))]
    while stack:
        bit, block = stack.pop()
        a0, a1, b0, b1, _ = block.T
        block = block[(root[a0] != root[b0]) | (run[a0] < a1) | (run[b0] < b1)]
        wide_of = (block[:, 1] - block[:, 0]).astype(np.int64) * (block[:, 3] - block[:, 2])
        small = (wide_of <= LEAF) if bit >= 0 else np.ones(len(block), bool)
        if small.any():
            leaf, sizes = block[small], wide_of[small]
            for part in _parts(sizes):
                test(*_products(leaf[part]))
            block = block[~small]
        if not len(block):
            continue
        z = below(bit)
        a0, a1, b0, b1, d = block.T
        am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
        own = (a0 == b0) & (a1 == b1)
        more = d + (bit >= BITS - top)
        children = [np.stack([a0, am, b0, bm, d], 1), np.stack([am, a1, bm, b1, d], 1), np.stack([a0, am, bm, b1, more], 1)]
        children.append(np.stack([am, a1, b0, bm, more], 1)[~own])
        block = np.concatenate(children)
        block = block[(block[:, 0] < block[:, 1]) & (block[:, 2] < block[:, 3]) & (block[:, 4] <= radius)]
        for k in range(0, len(block), BLOCK):
            stack.append((bit - 1, block[k : k + BLOCK]))
    settle()
    return found[0] if found else np.empty((0, 2), np.int64)


def _parts(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of leaves whose products stay near a quarter of a million."""
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(1 << 18, int(sizes.sum()) + (1 << 18), 1 << 18)) + 1
    begin = 0
    for end in np.minimum(cuts, len(sizes)).tolist():
        if end > begin:
            yield slice(begin, end)
            begin = end


def _products(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, cols = (pairs[:, 1] - pairs[:, 0]).astype(np.int64), (pairs[:, 3] - pairs[:, 2]).astype(np.int64)
    sizes = rows * cols
    of = np.repeat(np.arange(len(pairs)), sizes)
    k = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return pairs[of, 0] + k // cols[of], pairs[of, 2] + k % cols[of]


def _forest(links: np.ndarray, n: int) -> np.ndarray:
    """Links (node, root) with the same components as links."""
    root = np.arange(n)
    a, b = links.T
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            break
    nodes = np.flatnonzero(root != np.arange(n))
    return np.stack([nodes, root[nodes]], 1)


def _spanning(links: np.ndarray, n: int) -> np.ndarray:
    """Some of the links that connect what all of them do: each component takes one that leaves it, again and again."""
    root, kept = np.arange(n), np.zeros(len(links), bool)
    while True:
        a, b = root[links].T
        live = np.flatnonzero(a != b)
        if not len(live):
            return links[kept]
        first = np.unique(np.concatenate([a[live], b[live]]), return_index=True)[1]
        taken = np.unique(live[first % len(live)])
        kept[taken] = True
        step, forest = np.arange(n), _forest(np.stack([a[taken], b[taken]], 1), n)
        step[forest[:, 0]] = forest[:, 1]
        root = step[root]


def trie_links(fps: DataFrame, radius: int = 3, node_size: int = NODE_SIZE, min_depth: int = MIN_DEPTH) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect just the pairs at ``radius`` or fewer
    differing bits: every such pair is in one component of the links, and no component joins others."""
    ones = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(BITS)]
    counts = fps.agg(F.count(F.lit(1)).alias("n"), *ones).first()
    n = counts["n"]
    order = sorted(range(BITS), key=lambda i: (abs((counts[f"b{i}"] or 0) * 2 - n), i))
    depth = min(16, max(min_depth, math.ceil(math.log2(max(1, n / node_size)))))
    prefix = F.lit(0)
    for k, bit in enumerate(order[:depth]):
        prefix = prefix.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", bit).bitwiseAND(F.lit(1)).cast("int"), depth - 1 - k))
    masks = [sum(1 << i for i in c) for r in range(min(radius, depth) + 1) for c in combinations(range(depth), r)]
    dealt = _dealt(fps.select("fp", prefix.alias("prefix"), F.explode(F.array(*map(F.lit, masks))).alias("mask")))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, second = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["second"].to_numpy(bool)
        key = np.zeros(len(fp), np.uint64)
        for k, bit in enumerate(order):
            key |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(BITS - 1 - k)
        at = np.lexsort((key, second))
        return _named(fp[at], _links(key[at], _split(pdf, second), radius)) if _joins(pdf, second) else _named(fp, None)

    return _joined(dealt, ["lo", "hi"], join, node_size, n > node_size)


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (prefix, mask, ...) by the node pair (lo, hi); ``second`` marks the rows of node hi."""
    other = F.col("prefix").bitwiseXOR(F.col("mask"))
    lo, hi = F.least("prefix", other), F.greatest("prefix", other)
    return rows.withColumns({"lo": lo, "hi": hi, "second": F.col("prefix") > other}).drop("prefix", "mask")


def _joined(dealt: DataFrame, pair: list[str], join, node_size: int, cut: bool) -> DataFrame:
    """Links (a, b) that ``join`` finds in each node pair (columns ``pair``) of dealt. Without ``cut`` no pair
    can be large."""
    kind = "a long, b long"
    sizes = None
    if cut:
        sizes = dealt.groupBy(*pair).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LARGE * node_size)
        sizes = materialize(sizes, "simhash-large")
    if sizes is None or sizes.isEmpty():
        return dealt.groupBy(*pair).applyInPandas(join, kind)
    sizes = sized(sizes, 64)
    rest = dealt.join(sizes.select(*pair), pair, "left_anti").groupBy(*pair).applyInPandas(join, kind)
    return rest.union(_tiled(materialize(dealt.join(sizes, pair), "simhash-dense"), pair, join, node_size))


def _tiled(rows: DataFrame, pair: list[str], join, node_size: int) -> DataFrame:
    """The links of large node pairs (rows with their pair's ``size``) in tasks of about two nodes' rows.

    A pair's rows fall into blocks by a hash. First each block is joined with the first one, which puts a
    dense group into one component. Two rows that are not yet in one component are not both in the pair's
    largest: so the rows outside of it, in blocks of their own, are joined with all blocks, which makes the
    links complete. Copies of a row are as many as blocks lie outside; none if the pair is one group.
    """
    spread = F.xxhash64("fp", F.lit(1))
    rows = rows.withColumn("blocks", F.ceil(F.col("size") / node_size).cast("int"))
    first = rows.withColumns({"out": F.pmod(spread, "blocks") == 0, "outer": F.lit(1)})
    found = materialize(_tiles(first, pair, join, spread), "simhash-hubs")
    roots = connected_components(found)
    group = F.coalesce("root", "fp")
    tied = materialize(rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", group).drop("root"), "simhash-tied")
    sizes = tied.groupBy(*pair, "group").agg(F.count(F.lit(1)).alias("c"), F.first("size").alias("size"))
    most = sizes.groupBy(*pair).agg(F.max(F.struct("c", "group")).alias("m"), F.first("size").alias("s"))
    most = most.select(*pair, F.col("m.group").alias("most"), F.ceil((F.col("s") - F.col("m.c")) / node_size).cast("int").alias("outer"))
    most = sized(materialize(most, "simhash-most"), 64)
    left = tied.join(most, pair).withColumn("out", F.col("group") != F.col("most")).drop("group", "most")
    return found.union(_tiles(left.where("outer > 0"), pair, join, spread))


def _tiles(rows: DataFrame, pair: list[str], join, spread) -> DataFrame:
    """Joins each of the ``outer`` blocks of the rows marked ``out`` with each of the ``blocks`` of all rows."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(spread, n).cast("int")
    some = rows.where("out").withColumn("__i", own("outer")).withColumn("__j", every("blocks"))
    both = some.unionByName(rows.withColumn("__j", own("blocks")).withColumn("__i", every("outer")))
    both = both.drop("size", "blocks", "outer", "out")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        return join(pdf.drop_duplicates("fp"))

    return both.groupBy(*pair, "__i", "__j").applyInPandas(tile, "a long, b long")


def _joins(pdf: pd.DataFrame, second: np.ndarray) -> bool:
    """False if a pair of two nodes lacks the rows of one."""
    return bool(pdf["lo"].iat[0] == pdf["hi"].iat[0] or (second.any() and not second.all()))


def _split(pdf: pd.DataFrame, second: np.ndarray) -> int:
    return 0 if pdf["lo"].iat[0] == pdf["hi"].iat[0] else int((~second).sum())


def _named(fp: np.ndarray, links: np.ndarray | None) -> pd.DataFrame:
    links = np.empty((0, 2), np.int64) if links is None else links
    signed = fp.view(np.int64)
    return pd.DataFrame({"a": signed[links[:, 0]], "b": signed[links[:, 1]]})


def bit_limit(similarity: float, tables: int = TABLES) -> int:
    """The differing bits of all fingerprints that are expected of texts of one length with this Jaccard similarity."""
    return int(tables * BITS * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi)


def similar_links(rows: DataFrame, similarity: float, node_size: int = SIMILAR_NODE) -> DataFrame:
    """Candidate links (a, b) between nodes of rows (fp: the node, n: its shingles, fps: its fingerprints): pairs
    whose similarity is estimated at ``similarity`` or more, as many as connect all that are found.

    A window holds the lengths of two neighbouring steps of 1/similarity (and a hundredth, for rounding). A
    window of over ``node_size`` rows is cut by the top bits of the trie's key, and a node of near copies that
    is still larger into blocks. So tasks are bounded, and links across nodes are left to other tries and to the
    caller.
    """
    limit, step = bit_limit(similarity), math.log(1.01 / similarity)
    size = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / F.lit(step)).cast("int")
    rows = rows.select("fp", "fps", F.explode(F.array(size - 1, size)).alias("win"))
    # one row per step of the lengths: at most a few hundred
    counts = rows.groupBy("win").count().collect()
    deep = {r["win"]: min(TOP, math.ceil(math.log2(r["count"] / node_size))) for r in counts if r["count"] > node_size}
    depth = F.coalesce(F.create_map(*[F.lit(x) for kv in deep.items() for x in kv])[F.col("win")], F.lit(0)) if deep else F.lit(0)
    tries = rows.select("fp", "fps", "win", depth.alias("depth"), F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1))).alias("trie"))
    prefix = F.expr("CAST(CASE WHEN depth = 0 THEN 0 ELSE shiftrightunsigned(fps[trie], 64 - depth) END AS int)").alias("node")
    tries, key = tries.select("fp", "fps", "win", "trie", prefix), ["win", "trie", "node"]
    if deep:
        large = tries.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / node_size).cast("int").alias("blocks")).where("blocks > 1")
        large = sized(materialize(large, "near-large"), 64)
        tries = tries.join(large, key, "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("fp", "trie"), "blocks"), F.lit(0).cast("long"))).drop("blocks")
        key = [*key, "block"]

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, wide = pdf["fp"].to_numpy(np.int64), np.stack(pdf["fps"].to_numpy()).view(np.uint64)
        keys = wide[:, pdf["trie"].iat[0]]
        at = np.argsort(keys, kind="stable")
        return _named(fp[at], _links(keys[at], 0, RADIUS, TOP, wide[at], limit))

    return tries.groupBy(*key).applyInPandas(join, "a long, b long")


def with_components(prints: DataFrame, roots: DataFrame) -> DataFrame:
    """prints (doc_id, text_hash, fp) with component_id and component, from the roots (node, root) of the fingerprints
    that are linked: the smallest doc_id of the component (null if all of its ids are null). Copies of one fingerprint
    may be a large part of all rows: see ``join_groups``."""
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    tied = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("root", "fp"))
    tied = materialize(tied, "simhash-tied")
    low = tied.where("root IS NOT NULL").groupBy("component").agg(F.min("least").alias("component_id"))
    linked = tied.where("root IS NOT NULL").join(low, "component").select("fp", "copies", "component_id", "component")
    alone = tied.where("root IS NULL").select("fp", "copies", F.col("least").alias("component_id"), "component")
    groups = materialize(linked.union(alone), "simhash-components")
    return join_groups(prints, groups, "fp", "copies", 40).select("doc_id", "text_hash", "fp", "component_id", "component")


def simhash_classes(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text_hash, fp, component_id, component. Fingerprints link
    at ``radius`` or fewer differing bits.

    Null and empty texts have fingerprint zero. Repeated rows and ids are kept; rows without an id take
    part and only lack an id. An empty table gives an empty table; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, width), "simhash-docs")
    links = trie_links(materialize(prints.select("fp").distinct(), "simhash-flat"), radius)
    roots = materialize(connected_components(links), "simhash-roots")
    return with_components(prints, roots)


def simhash_dedup(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """docs with one row of each component of ``simhash_classes``: see ``keep_one``."""
    return keep_one(docs, simhash_classes(docs, width, radius))


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """docs with one row of each component: the one of the smallest doc_id (of rows that repeat that id,
    the least text hash; of wholly equal rows, one). All columns of docs are kept."""
    prints = materialize(classes, "simhash-classes")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    kept = prints.groupBy("component").agg(F.min(rank).alias("r"))
    kept = kept.select(F.col("r.i").alias("__i"), F.col("r.h").alias("__h"), F.lit(True).alias("__keep"))
    rows = prints.groupBy(F.col("doc_id").alias("__i"), F.col("text_hash").alias("__h")).agg(F.count(F.lit(1)).alias("__n"))
    fate = materialize(_fate(rows, kept), "simhash-fate")
    text_hash = F.xxhash64(docs["text"])
    drop = sized(fate.where("NOT __keep"), 24)
    out = docs.join(drop, docs["doc_id"].eqNullSafe(drop["__i"]) & (text_hash == drop["__h"]), "left_anti")
    again = fate.where("__keep AND __n > 1")
    if again.isEmpty():
        return out
    again = sized(again, 24)
    match = docs["doc_id"].eqNullSafe(again["__i"]) & (text_hash == again["__h"])
    once = out.join(again, match, "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(again, match, "left_anti").unionByName(once)


def _fate(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """rows (__i, __h, __n) with __keep."""
    both = rows.withColumn("__keep", F.lit(False)).unionByName(kept.withColumn("__n", F.lit(0).cast("long")))
    return both.groupBy("__i", "__h").agg(F.sum("__n").alias("__n"), F.max("__keep").alias("__keep"))
