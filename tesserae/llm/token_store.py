"""Content-addressed store of token ids.

A document's id stream is its tokens and the end id. It is cut where a rolling hash of the last 16 ids has its
low bits zero, so that shared passages give shared chunks wherever they lie; chunks have at most ``MAX_CHUNK`` ids.

Layout of a store (below one folder of the shared space; a home is a run of documents in ascending doc_id order, of
``HOME_IDS`` ids, numbered in that order):

* ``recipes`` (Parquet, range-partitioned and sorted, so its files hold the documents in ascending order): doc_id,
  n_tokens, the chunk digests and lengths in order, the home, and the document's leaf of the Merkle tree. ``parts``
  has the documents and ids before each file.
* ``packs``: files of chunk payloads (little-endian unsigned ids of ``id_bytes`` each). Every distinct chunk is stored
  once, in the pack of the first home that uses it, in the order of its first use.
* ``chunks``: for each pack its home, file, and the digests and lengths of its chunks in order. ``borrowed``: the
  digests that a home takes from the packs of others, with their owner's home.
* ``manifest``: the Merkle tree above the leaves, level by level, up to one root.

Tokenizing tasks write raw files of payloads and metadata; payloads are never shuffled, but copied by byte ranges
into the packs of their homes. Reading takes a home at a time: its pack, whole, and the chunks it borrows; each
chunk's digest, each leaf and the root are checked, and the id streams are joined again.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, scratch, trim
from .warc_zip import filesystem

END_ID = 1
MASK_BITS, MIN_CHUNK, MAX_CHUNK = 9, 64, 4096
FANOUT = 1024
#: Ids of a home, bytes of a raw file, and chunks that a task fetches for others at once.
HOME_IDS, RAW_BYTES, FETCH = 8 << 20, 64 << 20, 8192
#: A raw file's bytes are read in one piece where no gap between two wanted chunks is larger.
GAP = 1 << 16
#: Words kept in a worker's cache.
CACHE_WORDS = 600_000
_WINDOW = 16
#: Marks that are a piece of their own after a word (an apostrophe may begin a contraction).
_MARKS = ".,;:!?*#$%&()[]{}+-/=_~^@|<>\"\\`"


def _byte_chars() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    table |= {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in table)}
    return table


#: What the short cut of ``WordEncoder`` relies on in a tokenizer's file.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _PIECES}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordEncoder:
    """Ids of whole texts, quickly for tokenizers that drop white space and never join across it.

    A tokenizer of another normalizer, pre-tokenizer or model than expected is run on whole texts (``exact``).

    Texts are cut at blanks and line feeds. Words are kept in a bounded cache. Words of letters only in
    normal form, and the marks that end them, go to the BPE model itself; all others through the whole
    tokenizer. ``exact`` encodes without any of this.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.by_words = told["normalizer"] == _NORMALIZER and told["pre_tokenizer"] == _PRE_TOKENIZER and told["model"]["type"] == "BPE" and not told["model"]["dropout"] and told["truncation"] is None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chars = _byte_chars()
        self.cache: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def exact(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _model(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join(map(self.chars.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        core = word.rstrip(_MARKS)
        if core.isalpha() and (core.isascii() or unicodedata.is_normalized("NFC", core)) and core == core.lower():
            found = self.cache.get(core) or self._model(core)
            if len(core) == len(word):
                return found
            tail = word[len(core) :]
            if tail not in self.tails:
                self.tails[tail] = self._model(tail)
            return found + self.tails[tail]
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def stream(self, text: str | None) -> bytes:
        """The ids as unsigned 32-bit integers."""
        text = text or ""
        if not self.by_words or any(a in text for a in self.added):
            return self.exact(text).tobytes()
        low = text.lower()
        # lower case comes after normal form: both orders agree where both texts are in normal form
        if low.isascii() or "\u03a3" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low):
            text = low
        words = text.replace("\n", " ").split(" ")
        cache = self.cache
        parts = list(map(cache.get, words))
        at = -1
        try:
            while True:
                at = parts.index(None, at + 1)
                word = words[at]
                parts[at] = found = cache.get(word) or self._word(word)
                if len(cache) < CACHE_WORDS:
                    cache[word] = found
        except ValueError:
            return b"".join(parts)

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.stream(text), np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cuts(ids: np.ndarray, ends: np.ndarray | None = None) -> list[list[int]]:
    """Ends of the chunks of each id stream; the streams lie end to end and end at ``ends``."""
    ends = np.array([len(ids)]) if ends is None else ends
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    width = 1
    while width < _WINDOW:  # h[i] = sum of mix(ids[i - j]) << j over the window
        h[width:] = h[width:] + (h[:-width] << np.uint64(width))
        width *= 2
    # a window that reaches into the stream before ends too soon for a cut
    wanted = np.flatnonzero(h >> np.uint64(64 - MASK_BITS) == 0) + 1
    found, begin = [], 0
    for n, some in zip(ends.tolist(), np.split(wanted, np.searchsorted(wanted, ends[:-1], "right"))):
        own, last = [], begin
        for c in [*some.tolist(), n]:
            while c - last > MAX_CHUNK:
                last += MAX_CHUNK
                own.append(last)
            if c - last >= MIN_CHUNK or c == n and c > last:
                last = c
                own.append(c)
        found.append(own)
        begin = n
    return found


def _leaf(doc_id, n: int, digests: bytes) -> bytes:
    return hashlib.sha256(f"{doc_id or ''}:{n}:".encode() + digests).digest()


def _merkle(nodes: DataFrame, spark: SparkSession) -> DataFrame:
    """nodes (level 0: position, hash) with all levels above, up to a single root."""
    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        return pd.DataFrame({"position": [int(pdf["position"].iat[0]) // FANOUT], "hash": [hashlib.sha256(b"".join(pdf["hash"])).digest()]})

    out, level, now = None, 0, nodes
    while True:
        n = now.count()
        named = now.withColumn("level", F.lit(level))
        out = named if out is None else out.unionByName(named)
        if n <= 1:
            return out
        level += 1
        parent = F.floor(F.col("position") / FANOUT)
        now = materialize(now.groupBy(parent.alias("__p")).applyInPandas(up, "position long, hash binary"), f"store-merkle{level}")


def _order() -> list:
    return [F.col("doc_id").asc_nulls_first(), F.col("digests")]


class _Raw:
    """Raw files of one task: payloads end to end, a new file after ``RAW_BYTES``."""

    def __init__(self, folder: str) -> None:
        self.fs, self.root = filesystem(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.out, self.name, self.at, self.held = None, "", 0, bytearray()

    def add(self, payload: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= RAW_BYTES:
            self.close()
            self.name, self.at = uuid.uuid4().hex, 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}")
        at, self.at = self.at, self.at + len(payload)
        self.held += payload
        if len(self.held) >= 1 << 20:
            self._flush()
        return self.name, at

    def _flush(self) -> None:
        self.out.write(bytes(self.held))
        self.held.clear()

    def close(self) -> None:
        if self.out is not None:
            self._flush()
            self.out.close()
            self.out = None


def _ranges(fs, path: str, offsets: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The byte ranges of a file, in the order given; neighbours are read together."""
    order = np.argsort(offsets, kind="stable")
    begin, end = offsets[order], offsets[order] + sizes[order]
    cut = np.flatnonzero(begin[1:] - np.maximum.accumulate(end)[:-1] > GAP) + 1
    out: list[bytes] = [b""] * len(order)
    with fs.open_input_file(path) as f:
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(order)]):
            low = int(begin[a])
            held = f.read_at(int(end[a:b].max()) - low, low)
            for k in range(a, b):
                out[order[k]] = held[begin[k] - low : end[k] - low]
    return out


def write_store(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = END_ID, id_bytes: int = 2) -> str:
    """Writes the id streams of docs (doc_id, text) and returns the store's folder.

    Null and empty texts are streams of the end id alone. Rows that repeat an id are documents of their
    own, in the order of their recipes; null ids come first. An empty table makes a store without
    documents. Other columns are ignored. ``id_bytes`` 2 serves vocabularies up to 65,536 ids.

    Files that a lost task leaves have names of their own and are in no table; raw files go when the store is whole.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 256)
    path, raw_path = path or scratch(spark, "store"), scratch(spark, "store-raw-files")
    kind = np.dtype(f"<u{id_bytes}")

    kinds = "doc_id string, n_tokens long, digests binary, lengths binary, leaf binary, digest binary, file string, offset long"
    mark = np.array([end_id], np.uint32).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sent, raw = encoder(tokenizer_path), set(), _Raw(raw_path)
        for batch in batches:
            doc_ids = batch.column(0).cast(pa.string()).to_pylist()
            streams = [enc.stream(t) + mark for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, streams), np.int64, len(streams)) // 4
            ids = np.frombuffer(b"".join(streams), np.uint32)
            if len(ids) and ids.max() >= 1 << (8 * id_bytes):
                raise ValueError("an id does not fit in id_bytes")
            payload = ids.astype(kind).tobytes()
            whole, all_lengths, leaves, fresh, files, offsets = [], [], [], [], [], []
            last = 0
            for doc_id, size, ends in zip(doc_ids, sizes.tolist(), cuts(ids, np.cumsum(sizes)) if len(ids) else ()):
                digests, lengths = [], []
                for end in ends:
                    part = payload[last * id_bytes : end * id_bytes]
                    digests.append(digest := hashlib.blake2b(part, digest_size=16).digest())
                    lengths.append(end - last)
                    last = end
                    if digest not in sent:
                        if len(sent) < 1 << 18:
                            sent.add(digest)
                        name, at = raw.add(part)
                        fresh.append(digest)
                        files.append(name)
                        offsets.append(at)
                whole.append(b"".join(digests))
                all_lengths.append(np.array(lengths, "<i4").tobytes())
                leaves.append(_leaf(doc_id, size, whole[-1]))
            # the documents' rows, then those of the chunks
            n, m, string, binary = len(sizes), len(fresh), pa.string(), pa.binary()
            columns = [
                pa.concat_arrays([pa.array(doc_ids, string), pa.nulls(m, string)]), pa.concat_arrays([pa.array(sizes), pa.nulls(m, pa.int64())]),
                *[pa.concat_arrays([pa.array(x, binary), pa.nulls(m, binary)]) for x in (whole, all_lengths, leaves)],
                pa.concat_arrays([pa.nulls(n, binary), pa.array(fresh, binary)]), pa.concat_arrays([pa.nulls(n, string), pa.array(files, string)]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(offsets, pa.int64())]),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in kinds.split(", ")])
        raw.close()
        trim()

    raw = materialize(docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(cut, kinds), "store-raw")
    _write_recipes(raw, path)
    # each chunk is owned by the first home that uses it, and copied there from one of its raw copies
    homes = _uses(spark.read.parquet(f"{path}/recipes")).withColumn("owner", F.min("home").over(Window.partitionBy("digest")))
    homes = materialize(homes, "store-uses")
    copy = raw.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("file", "offset")).alias("c")).select("digest", F.col("c.file").alias("file"), F.col("c.offset").alias("offset"))
    own = homes.where("home = owner").select("digest", "home", "at", "n").join(copy, "digest")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at").reset_index(drop=True)
        fs, raw_root = filesystem(raw_path)
        _, root = filesystem(f"{path}/packs")
        fs.create_dir(root, recursive=True)
        sizes, parts = pdf["n"].to_numpy(np.int64) * id_bytes, [b""] * len(pdf)
        for name, some in pdf.groupby("file"):
            for k, payload in zip(some.index, _ranges(fs, f"{raw_root}/{name}", some["offset"].to_numpy(np.int64), sizes[some.index])):
                parts[k] = payload
        home = int(pdf["home"].iat[0])
        file = f"{home:016x}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{root}/{file}") as out:
            out.write(b"".join(parts))
        return pd.DataFrame({"home": [home], "file": [file], "digests": [b"".join(pdf["digest"])], "lengths": [pdf["n"].to_numpy("<i4").tobytes()]})

    own.groupBy("home").applyInPandas(pack, "home long, file string, digests binary, lengths binary").write.parquet(f"{path}/chunks")
    homes.where("home != owner").select("home", "digest", "owner").write.parquet(f"{path}/borrowed")
    _merkle(_leaves(spark, path), spark).where("level > 0").write.parquet(f"{path}/manifest")
    at = spark._jvm.org.apache.hadoop.fs.Path(raw_path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return path


def _write_recipes(raw: DataFrame, path: str) -> None:
    """``recipes`` and ``parts``. Documents are sorted by ranges of doc_id, and numbered as they are written: within
    their partition, whose sums are added later, so nothing is shuffled again and files stay in order."""
    spark = raw.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = raw.where("digest IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "digests", "lengths", "leaf")
    dealt = rows.repartitionByRange(parts, *_order()).sortWithinPartitions(*_order())
    dealt = dealt.withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = ids = 0
        for batch in batches:
            n, part = batch.column(1).to_numpy(), batch.column(5).to_numpy().astype(np.int64)
            begin = ids + np.cumsum(n) - n
            made = [np.arange(row, row + len(n)), begin, (part << 32) + begin // HOME_IDS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], [*batch.schema.names, "row", "begin", "home"])
            row, ids = row + len(n), ids + int(n.sum())

    dealt.mapInArrow(number, "doc_id long, n_tokens long, digests binary, lengths binary, leaf binary, part int, row long, begin long, home long").write.parquet(f"{path}/recipes")
    sums = spark.read.parquet(f"{path}/recipes").groupBy("part").agg(F.sum("n_tokens").alias("s"), F.count(F.lit(1)).alias("c"))
    w, zero = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1), F.lit(0).cast("long")
    sums.select("part", F.coalesce(F.sum("c").over(w), zero).alias("rows_before"), F.coalesce(F.sum("s").over(w), zero).alias("ids_before")).write.parquet(f"{path}/parts")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes with ``position`` and ``start`` in the whole store."""
    # one row per range partition of the writer
    parts = F.broadcast(spark.read.parquet(f"{path}/parts"))
    rows = spark.read.parquet(f"{path}/recipes").join(parts, "part")
    return rows.withColumns({"position": F.col("rows_before") + F.col("row"), "start": F.col("ids_before") + F.col("begin")})


def _leaves(spark: SparkSession, path: str) -> DataFrame:
    return _recipes(spark, path).select("position", F.col("leaf").alias("hash"))


def _uses(recipes: DataFrame) -> DataFrame:
    """(digest, home, at, n): the chunks that each home uses, once, by the place of their first use."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, begin = (batch.column(k).to_numpy() for k in (0, 1))
            digests, lengths = (b"".join(batch.column(k).to_pylist()) for k in (2, 3))
            size = np.frombuffer(lengths, "<i4")
            before = np.cumsum(size, dtype=np.int64) - size
            counts = pc.divide(pc.binary_length(batch.column(3)), 4).to_numpy().astype(np.int64)
            first = np.cumsum(counts) - counts
            # every document has a chunk
            at = before + np.repeat(begin - before[first], counts)
            ends = np.arange(0, 16 * (len(size) + 1), 16, dtype=np.int32)
            digest = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(digests)])
            yield pa.RecordBatch.from_arrays([digest, pa.array(np.repeat(home, counts)), pa.array(at), pa.array(size)], ["digest", "home", "at", "n"])

    rows = recipes.select("home", "begin", "digests", "lengths").mapInArrow(spread, "digest binary, home long, at long, n int")
    return rows.groupBy("digest", "home").agg(F.min("at").alias("at"), F.first("n").alias("n"))


def read_streams(spark: SparkSession, path: str, each: Callable[[np.ndarray], tuple], kinds: str, id_bytes: int = 2) -> DataFrame:
    """doc_id, start, n_tokens of every document, and the columns (``kinds``) that ``each`` makes of its ids.

    Streams are joined from the chunks of the store's packs. Every chunk's digest, every recipe's leaf and lengths,
    and the Merkle root are verified; a chunk that is missing or altered raises."""
    arrow_rows(spark, 1024)
    kind = np.dtype(f"<u{id_bytes}")
    names = [x.split()[0] for x in kinds.split(",")]
    packs = spark.read.parquet(f"{path}/chunks")

    def load(file: str, digests: bytes, lengths: bytes) -> dict[bytes, bytes]:
        """The chunks of a pack, checked."""
        fs, root = filesystem(f"{path}/packs")
        with fs.open_input_file(f"{root}/{file}") as f:
            data = f.read()
        held, at = {}, 0
        for k, n in enumerate(np.frombuffer(lengths, "<i4").tolist()):
            digest, part = digests[16 * k : 16 * k + 16], data[at : at + n * id_bytes]
            if hashlib.blake2b(part, digest_size=16).digest() != digest:
                raise ValueError("a chunk does not match its digest")
            held[digest] = part
            at += n * id_bytes
        return held

    def lend(wanted: pd.DataFrame, packs: pd.DataFrame) -> pd.DataFrame:
        held = load(*packs[["file", "digests", "lengths"]].iloc[0]) if len(packs) else {}
        return pd.DataFrame({"home": wanted["home"], "digest": wanted["digest"], "payload": [held.get(d) for d in wanted["digest"]]})

    # a pack that many homes borrow from is read by several tasks
    wanted = spark.read.parquet(f"{path}/borrowed")
    shares = wanted.groupBy("owner").agg(F.ceil(F.count(F.lit(1)) / FETCH).alias("shares"))
    wanted = wanted.join(shares, "owner").withColumn("share", F.concat_ws("/", "owner", F.pmod(F.xxhash64("home"), "shares")))
    lenders = packs.join(shares, packs["home"] == shares["owner"]).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    lenders = lenders.select("file", "digests", "lengths", F.concat_ws("/", "owner", "k").alias("share"))
    lent = wanted.select("home", "digest", "share").groupBy("share").cogroup(lenders.groupBy("share")).applyInPandas(lend, "home long, digest binary, payload binary")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("file", "string"), ("digests", "binary"), ("lengths", "binary"))]
    empty = [F.lit(None).cast("binary").alias(c) for c in ("digest", "payload")]
    pieces = packs.select("home", "file", "digests", "lengths", *empty).unionByName(lent.select("home", "digest", "payload", *none))

    def join(recipes: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        held = {}
        for file, digests, lengths in pieces.loc[pieces["file"].notna(), ["file", "digests", "lengths"]].itertuples(index=False):
            held |= load(file, digests, lengths)
        lent = pieces[pieces["payload"].notna()]
        held |= dict(zip(lent["digest"], lent["payload"]))
        out = []
        for i, n, d, lens, leaf in zip(recipes["doc_id"], recipes["n_tokens"].tolist(), recipes["digests"], recipes["lengths"], recipes["leaf"]):
            if _leaf(i, n, d) != leaf:
                raise ValueError("a recipe does not match its leaf")
            try:
                parts = [held[d[k : k + 16]] for k in range(0, len(d), 16)]
            except KeyError:
                raise ValueError("a chunk is missing") from None
            ids = np.frombuffer(b"".join(parts), kind)
            if len(ids) != n or [len(x) // id_bytes for x in parts] != np.frombuffer(lens, "<i4").tolist():
                raise ValueError("a recipe's chunks do not add up to its tokens")
            out.append(each(ids))
        made = recipes[["doc_id", "start", "n_tokens"]].reset_index(drop=True)
        for k, name in enumerate(names):
            made[name] = [x[k] for x in out]
        return made

    recipes = _recipes(spark, path).select("home", F.col("doc_id").cast("string").alias("doc_id"), "start", "n_tokens", "digests", "lengths", "leaf")
    check_manifest(spark, path)
    rows = recipes.groupBy("home").cogroup(pieces.groupBy("home")).applyInPandas(join, f"doc_id string, start long, n_tokens long, {kinds}")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def read_store(spark: SparkSession, path: str, id_bytes: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of every document: see
    ``read_streams``."""
    return read_streams(spark, path, lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),), "ids_crc32 long", id_bytes)


def read_ids(spark: SparkSession, path: str, id_bytes: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document: see ``read_streams``."""
    return read_streams(spark, path, lambda ids: (ids.astype(np.int64),), "ids array<long>", id_bytes)


def check_manifest(spark: SparkSession, path: str) -> None:
    """Recomputes the tree over the recipes' leaves and compares its nodes with the manifest's."""
    kept = spark.read.parquet(f"{path}/manifest").select("level", "position", "hash")
    made = _merkle(materialize(_leaves(spark, path), "store-leaves"), spark).where("level > 0").select("level", "position", "hash")
    same = made.join(kept.withColumnRenamed("hash", "kept"), ["level", "position"], "full").where("NOT (hash <=> kept)")
    if not same.isEmpty():
        raise ValueError("the recipes do not match the Merkle manifest")
