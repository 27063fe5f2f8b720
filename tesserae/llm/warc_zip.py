"""WARC records in ZIP packages, read by ranges without extraction.

A package is a ZIP archive with stored (uncompressed) members: ``archive/data.warc.gz`` (one gzip member
per record) and ``indexes/index.cdxj`` (one JSON line per record: offset and length in the archive). The
reader parses the end of central directory record, its ZIP64 form where a field overflows, the central
directory and the local headers, and from then on reads single records by byte ranges.

Files go through ``pyarrow.fs`` and live in the shared folder, on whatever store its URI names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, join_groups, materialize, scratch

REVISIT_LEAST = 1000
PACKAGE_BYTES = 16 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
# Signatures and layouts of the ZIP format.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_LOCAL_FORM, _CENTRAL_FORM, _END_FORM, _END64_FORM, _LOCATOR64_FORM = "<IHHHHHIIIHH", "<IHHHHHHIIIHHHHHII", "<IHHHHIIH", "<IQHHIIQQQQ", "<IIQI"
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF
_DATE = (1 << 5) | 1  # 1980-01-01


def filesystem(uri: str):
    """(file system, path) of a URI or path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_zip(out, members: list[tuple[str, bytes]], zip64: bool = False) -> None:
    """Writes stored members. zip64 forces the ZIP64 fields, which large archives get anyway."""
    at, entries = 0, []
    for name, data in members:
        raw, crc, size = name.encode(), zlib.crc32(data), len(data)
        wide = zip64 or size >= _FULL32 or at >= _FULL32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        head = struct.pack(_LOCAL_FORM, _LOCAL, 45 if wide else 20, 0x800, 0, 0, _DATE, crc, *([_FULL32] * 2 if wide else [size] * 2), len(raw), len(extra))
        for part in (head, raw, extra, data):
            out.write(part)
        entries.append((raw, crc, size, at, wide))
        at += len(head) + len(raw) + len(extra) + size
    begin = at
    for raw, crc, size, where, wide in entries:
        extra = struct.pack("<HHQQQ", 1, 24, size, size, where) if wide else b""
        head = struct.pack(_CENTRAL_FORM, _CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, _DATE, crc, *([_FULL32] * 2 if wide else [size] * 2), len(raw), len(extra), 0, 0, 0, 0, _FULL32 if wide else where)
        for part in (head, raw, extra):
            out.write(part)
        at += len(head) + len(raw) + len(extra)
    n, length = len(entries), at - begin
    wide = zip64 or n >= _FULL16 or begin >= _FULL32
    if wide:
        out.write(struct.pack(_END64_FORM, _END64, 44, 45, 45, 0, 0, n, n, length, begin))
        out.write(struct.pack(_LOCATOR64_FORM, _LOCATOR64, 0, at, 1))
    out.write(struct.pack(_END_FORM, _END, 0, 0, *([_FULL16] * 2 if wide else [n] * 2), *([_FULL32] * 2 if wide else [length, begin]), 0))


class ZipReader:
    """Members of a ZIP archive in a random access file (``read_at(length, offset)``, as pyarrow's)."""

    def __init__(self, file, size: int) -> None:
        self.read = lambda offset, length: file.read_at(length, offset)
        tail_at = max(0, size - (22 + 0xFFFF + 20))
        tail = self.read(tail_at, size - tail_at)
        k = tail.rfind(struct.pack("<I", _END))
        while k >= 0 and tail_at + k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != size:
            k = tail.rfind(struct.pack("<I", _END), 0, k)
        if k < 0:
            raise ValueError("no end of central directory")
        _, _, _, _, n, length, begin, _ = struct.unpack_from(_END_FORM, tail, k)
        if n == _FULL16 or length == _FULL32 or begin == _FULL32:
            if k < 20 or struct.unpack_from("<I", tail, k - 20)[0] != _LOCATOR64:
                raise ValueError("no ZIP64 locator")
            where = struct.unpack_from(_LOCATOR64_FORM, tail, k - 20)[2]
            wide = struct.unpack(_END64_FORM, self.read(where, 56))
            if wide[0] != _END64:
                raise ValueError("no ZIP64 end of central directory")
            n, length, begin = wide[7:]
        self.members: dict[str, tuple[int, int, int, int]] = {}
        directory, p = self.read(begin, length), 0
        for _ in range(n):
            f = struct.unpack_from(_CENTRAL_FORM, directory, p)
            if f[0] != _CENTRAL:
                raise ValueError("bad central directory")
            method, crc, packed, plain, nn, ne, nc, at = f[4], f[7], f[8], f[9], f[10], f[11], f[12], f[16]
            name = directory[p + 46 : p + 46 + nn].decode()
            extra, q = directory[p + 46 + nn : p + 46 + nn + ne], 0
            while q + 4 <= len(extra):
                kind, m = struct.unpack_from("<HH", extra, q)
                if kind == 1:  # holds, in order, just the fields that overflow
                    values = iter(struct.unpack_from(f"<{m // 8}Q", extra, q + 4))
                    plain, packed, at = (next(values) if v == _FULL32 else v for v in (plain, packed, at))
                q += 4 + m
            self.members[name] = (at, packed, method, crc)
            p += 46 + nn + ne + nc

    def locate(self, name: str) -> tuple[int, int]:
        """(offset, length) of a stored member's bytes in the file."""
        at, packed, method, _ = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is not stored")
        head = struct.unpack(_LOCAL_FORM, self.read(at, 30))
        if head[0] != _LOCAL:
            raise ValueError("bad local header")
        return at + 30 + head[9] + head[10], packed

    def range(self, name: str, offset: int, length: int) -> bytes:
        begin, size = self.locate(name)
        if offset < 0 or offset + length > size:
            raise ValueError("range outside the member")
        return self.read(begin + offset, length)


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, key)}>"


def _line(url: str | None) -> str:
    return "".join(c if " " < c else "%{:02X}".format(ord(c)) for c in url or "") or "urn:none"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; refers_to makes it a revisit, without the payload."""
    digest = hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    key = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id('page:' + key)}", "WARC-Date: 1980-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest.digest()).decode()}", "Content-Type: application/http; msgtype=response", f"X-Page-ID: {key}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(f'page:{refers_to}')}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(head) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record: page_id (as text), url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.partition(b":")[2]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != sizes[0]):
        raise ValueError("a payload does not match its digest")
    return {
        "page_id": fields["x-page-id"] or None, "url": fields["warc-target-uri"], "payload_bytes": sizes[0], "payload_digest": digest,
        "record_type": fields["warc-type"], "refers_to": fields["x-refers-to-page"] if revisit else None, "payload": None if revisit else payload,
    }


def plan_revisits(pages: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """pages (page_id, url, html) with refers_to: of equal payloads of at least ``least`` bytes, the largest
    page_id is the response that the others refer to. Pages without an id refer to it too; rows that repeat that id
    are all responses. Null payloads are empty."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    size = F.octet_length(body)
    # smaller payloads have no digest, so no group
    marked = pages.withColumn("sha", F.when(size >= least, F.sha2(body, 256)))
    groups = marked.where("sha IS NOT NULL").groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("c"))
    groups = materialize(groups.where("c > 1"), "warc-groups")
    out = join_groups(marked, groups, "sha", "c", 80, "left")
    return out.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write_packages(pages: DataFrame, path: str, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Writes pages (page_id, url, html, refers_to) as packages below path; returns their names (package, n).

    Nulls: an html is an empty payload, a url ``urn:none``, a page_id is written as none, and no refers_to makes a
    response. Repeated rows are records of their own; an empty table gives no package; other columns are ignored.
    A page is in one record, however long. A task that is run again writes under new names; only the packages named
    in the result count."""
    arrow_rows(pages.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        body, index, n = io.BytesIO(), [], 0

        def close() -> pd.DataFrame:
            nonlocal body, index, n
            name = f"{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(f"{root}/{name}") as out:
                write_zip(out, [(ARCHIVE, body.getvalue()), (INDEX, "".join(index).encode())], zip64)
            made = pd.DataFrame({"package": [name], "n": [n]})
            body, index, n = io.BytesIO(), [], 0
            return made

        for pdf in batches:
            for page_id, url, html, refers in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"]):
                page_id, refers = (None if x is None else int(x) for x in (page_id, refers))
                packed = gzip.compress(warc_record(page_id, url, (html or "").encode(), refers), 3, mtime=0)
                index.append(json.dumps({"page_id": page_id, "offset": body.tell(), "length": len(packed)}) + "\n")
                body.write(packed)
                n += 1
                if body.tell() >= package_bytes:
                    yield close()
        if n:
            yield close()

    return materialize(pages.select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string")).mapInPandas(rows, "package string, n long"), "warc-packages")


def read_packages(spark: SparkSession, packages: DataFrame, path: str) -> DataFrame:
    """Every record of the named packages (column package, below path): page_id, url, payload_bytes,
    payload_digest, record_type, refers_to. Responses are checked against their digests.

    An id that was written as none is null; a package named twice is read twice; no packages give an empty table; a
    package that is damaged or missing raises."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(path)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for pdf in batches:
            for name in pdf["package"]:
                where = f"{root}/{name}"
                with fs.open_input_file(where) as f:
                    z = ZipReader(f, f.size())
                    archive, index = z.locate(ARCHIVE), z.locate(INDEX)
                    out = []
                    for line in z.read(index[0], index[1]).splitlines():
                        at = json.loads(line)
                        if at["offset"] + at["length"] > archive[1]:
                            raise ValueError("an index entry points outside the archive")
                        record = parse_record(gzip.decompress(z.read(archive[0] + at["offset"], at["length"])))
                        out.append([record[k] for k in names])
                yield pd.DataFrame(out, columns=names)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = packages.select("package").repartition(parts, "package").mapInPandas(rows, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def archive_round_trip(pages: DataFrame, zip64: bool = False) -> DataFrame:
    """Writes pages (page_id, url, html) as packages in the shared folder and returns what reading them
    gives: one row per page.

    A null html is an empty payload; a null page_id is written as none and never referred to while its
    group has another id. Rows that repeat both id and payload are all responses. An empty table gives an
    empty table; other columns are ignored.
    """
    path = scratch(pages.sparkSession, "warc")
    return read_packages(pages.sparkSession, write_packages(plan_revisits(pages), path, zip64=zip64), path)


SQL_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
g AS (SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS last FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM g
"""
