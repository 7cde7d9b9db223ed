"""WARC records in ZIP-packaged archives, written, and read back by ranges without extraction.

An archive is a ZIP file whose members are stored, not deflated: `archive/data.warc.gz` (one gzip member per WARC
record) and `indexes/index.cdx` (a line per record: id, type, offset, length). The reader parses the end record, the
ZIP64 end record and extra fields, and the central directory, finds the stored members' data, and reads each
record by its own range of bytes.

Equal payloads: of those with at least `least` bytes, the record of the largest id is the response and the others
are revisit records that refer to it. Only digests are compared and joined; a payload moves once, to its archive.

Archives travel as rows (name, content) of a table in the shared folder, so any store that Spark can write will do
and a lost executor's work is redone by Spark's own commit protocol; `ZipArchive` reads any file or object that offers
read(offset, length), and `read_archives` takes binaryFile tables too.

Defined results: a null page is an empty payload; a null id is smaller than any other; rows that repeat an id with the
same payload are all responses if the id is the largest; an empty table gives no archives; a very long page is a record like
any other.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import struct
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_back, partitions, store

LEAST_BYTES, ARCHIVE_BYTES = 1000, 8 << 20
#: Archives that one task builds, one after the other.
TOGETHER = 4
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_NULL = -(2**63)


def _digest(hex_sha1: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_sha1)).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id(urn: str) -> int | None:
    value = urn.strip("<>").rpartition(":")[2]
    return None if value == "none" else int(value)


def warc_record(page_id: int | None, url: str | None, payload: bytes, hex_sha1: str, refers_to: int | None) -> bytes:
    block = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {' '.join(url.split())}")
    head += [f"WARC-Payload-Digest: {_digest(hex_sha1)}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


def parse_record(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *fields = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in fields)}
    n = int(headers["content-length"])
    if len(rest) < n:
        raise ValueError("the record is cut short")
    return Record(headers, rest[:n])


def build_archive(records: list[tuple[int | None, str | None, bytes, str, int | None]], level: int = 1) -> bytes:
    data, index = io.BytesIO(), []
    for page_id, url, payload, sha, refers_to in records:
        at = data.tell()
        data.write(gzip.compress(warc_record(page_id, url, payload, sha, refers_to), level, mtime=0))
        index.append(f"{_urn(page_id)} {'response' if refers_to is None else 'revisit'} {at} {data.tell() - at}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, content in ((DATA, data.getvalue()), (INDEX, "".join(x + "\n" for x in index).encode())):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


@dataclass
class Member:
    name: str
    method: int
    stored: int
    size: int
    header: int


class ZipArchive:
    """The directory of a ZIP file and ranges of its stored members."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        self.read, self.size = read, size
        self.members = {m.name: m for m in self._directory()}

    @classmethod
    def of_bytes(cls, content: bytes) -> ZipArchive:
        return cls(lambda at, n: content[at : at + n], len(content))

    @classmethod
    def of_file(cls, path: str) -> ZipArchive:
        def read(at: int, n: int) -> bytes:
            with open(path, "rb") as f:
                f.seek(at)
                return f.read(n)

        return cls(read, os.path.getsize(path))

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 65557)
        tail = self.read(tail_at, self.size - tail_at)
        at = len(tail) - 22
        while at >= 0 and not (tail[at : at + 4] == b"PK\5\6" and struct.unpack_from("<H", tail, at + 20)[0] == len(tail) - at - 22):
            at -= 1
        if at < 0:
            raise ValueError("no end record: not a ZIP file")
        entries, length, start = struct.unpack_from("<HII", tail, at + 10)
        if entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = self.read(tail_at + at - 20, 20)
            if locator[:4] != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            end = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end record")
            entries, length, start = struct.unpack_from("<QQQ", end, 32)
        directory, at = self.read(start, length), 0
        for _ in range(entries):
            if directory[at : at + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            stored, size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
            header = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # ZIP64: only the fields that don't fit, in this order
                    wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    size = wide.pop(0) if size == 0xFFFFFFFF else size
                    stored = wide.pop(0) if stored == 0xFFFFFFFF else stored
                    header = wide.pop(0) if header == 0xFFFFFFFF else header
                extra = extra[4 + n :]
            yield Member(name, method, stored, size, header)
            at += 46 + n_name + n_extra + n_comment

    def range(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """Bytes of a stored member, read in place."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed: ranges of it can't be read")
        head = self.read(m.header, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError("broken local header")
        data = m.header + 30 + sum(struct.unpack_from("<HH", head, 26))
        length = m.size - offset if length is None else length
        if offset < 0 or length < 0 or offset + length > m.size:
            raise ValueError("the range lies outside the member")
        return self.read(data + offset, length)

    def records(self) -> Iterator[Record]:
        """Each indexed record, by its own range."""
        for line in self.range(INDEX).decode().splitlines():
            _, _, at, n = line.rsplit(" ", 3)
            yield parse_record(gzip.decompress(self.range(DATA, int(at), int(n))))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """path, content: archives with one record per row of pages."""
    rows = pages.select(F.coalesce(F.col(id_col), F.lit(_NULL)).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("key"))
    light = rows.where(F.octet_length("payload") >= least).select("id", "key")
    groups = light.groupBy("key").agg(F.max("id").alias("top"), F.min("id").alias("low")).where("top > low").select("key", "top")
    revisits = join_back(light, groups, ["key"]).where("id < top").distinct()
    total = rows.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    n = max(partitions(pages.sparkSession), -(-total // archive_bytes))

    def dealt(*by: str) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")

    def build(d: pd.DataFrame, refers: pd.DataFrame) -> pd.DataFrame:
        if not len(d):
            return pd.DataFrame({"path": [], "content": []})
        top = dict(zip(zip(refers["page"].tolist(), refers["same"], strict=True), refers["top"].tolist(), strict=True))
        d = d.sort_values(["id", "key"])
        records = [(None if i == _NULL else i, u, bytes(p), s, top.get((i, k))) for i, u, p, s, k in zip(d["id"].tolist(), d["url"], d["payload"], d["sha1"], d["key"], strict=True)]
        return pd.DataFrame({"path": [f"part-{d['archive'].iloc[0]:06d}.zip"], "content": [build_archive(records)]})

    tasks = max(partitions(pages.sparkSession), -(-n // TOGETHER))  # by the bytes there are, whatever the session's setting
    small = F.octet_length("payload") < least  # never revisits, so their copies need not meet
    payloads = rows.select(F.when(small, dealt("id", "key", "url")).otherwise(dealt("id", "key")).alias("archive"), "*").repartition(tasks, "archive").groupBy("archive")
    refers = revisits.select(F.col("id").alias("page"), F.col("key").alias("same"), F.col("top").alias("top")).select(dealt("page", "same").alias("archive"), "page", "same", "top")
    refers = refers.repartition(tasks, "archive").groupBy("archive")
    return payloads.cogroup(refers).applyInPandas(build, "path string, content binary")  # a payload moves once


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per WARC record of archives (path, content): id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for content in d["content"]:
                rows = []
                for r in ZipArchive.of_bytes(bytes(content)).records():
                    h = r.headers
                    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                    response = h["warc-type"] == "response"
                    if response and hashlib.sha1(r.block).hexdigest() != digest:
                        raise ValueError("a payload doesn't match its digest")
                    size = len(r.block) if response else int(h["x-payload-length"])
                    rows.append((_id(h["warc-record-id"]), size, digest, h["warc-type"], None if response else _id(h["warc-refers-to"]), h.get("warc-target-uri"), r.block if response else None))
                out = pd.DataFrame(rows, columns=["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"], dtype=object)
                yield out

    return archives.select("content").mapInPandas(read, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives to the shared folder and reads their records back."""
    return read_archives(store(write_archives(pages, id_col, url_col, html_col, least, archive_bytes))).withColumnRenamed("id", id_col)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT p.page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN g.top IS NOT NULL AND p.page_id < g.top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < g.top THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""
