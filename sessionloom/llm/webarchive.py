"""WARC records in ZIP packages: members are stored, so records are read by byte ranges without extraction.

A package holds ``archive/data.warc.gz``, one gzip member per record, and ``indexes/index.cdx``, a line per record with
its range. The reader parses the end record, the ZIP64 end record if there is one, and the central directory, finds where
the stored members begin, and reads each record by its range.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.shared import new_path, storage, written

#: Bytes of records after which a package is closed and the next begins.
PACKAGE_BYTES = 64 << 20
#: Payloads smaller than this are never revisits.
LEAST_REVISIT = 0
#: Digests that are broadcast at most, and pages with one digest from which it is common; few digests can be.
FIRSTS, COMMON = 200_000, 10_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_U16, _U32 = 0xFFFF, 0xFFFFFFFF


@dataclass
class Member:
    """An entry of a central directory."""

    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


def _entry(name: bytes, crc: int, size: int, header: int | None, zip64: bool) -> bytes:
    """A local header (``header`` None) or a central directory entry of a stored member; long fields go to ZIP64."""
    wide = zip64 or size >= _U32 or (header or 0) >= _U32
    extra = struct.pack("<HHQQ", 1, 16, size, size) if header is None else struct.pack("<HHQQQ", 1, 24, size, size, header)
    extra = extra if wide else b""
    short, need = (_U32 if wide else size), 45 if wide else 20
    if header is None:
        return struct.pack("<4s5H3I2H", b"PK\3\4", need, 0x800, 0, 0, 0x21, crc, short, short, len(name), len(extra)) + name + extra
    return struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, need, 0x800, 0, 0, 0x21, crc, short, short, len(name), len(extra), 0, 0, 0, 0, _U32 if wide else header) + name + extra


def write_package(out: BinaryIO, members: list[tuple[str, bytes | memoryview]], zip64: bool = False) -> None:
    """A ZIP of stored members; ``zip64`` writes the long form even where the short one would do."""
    directory, at = [], 0
    for name, data in members:
        crc = binascii.crc32(data)
        head = _entry(name.encode(), crc, len(data), None, zip64)
        out.write(head)
        out.write(data)
        directory.append(_entry(name.encode(), crc, len(data), at, zip64))
        at += len(head) + len(data)
    central = b"".join(directory)
    out.write(central)
    n = len(members)
    if zip64 or at >= _U32 or n >= _U16:
        out.write(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(central), at))
        out.write(struct.pack("<4sIQI", b"PK\6\7", 0, at + len(central), 1))
        out.write(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, _U16, _U16, _U32, _U32, 0))
    else:
        out.write(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, n, n, len(central), at, 0))


class Package:
    """Reads a package by ranges; ``read(start, length)`` gives bytes of the file and ``size`` is its length."""

    def __init__(self, read, size: int):
        self.read = read
        tail = read(max(0, size - 22 - _U16), min(size, 22 + _U16))
        end = tail.rfind(b"PK\5\6")
        if end < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack_from("<10xHII", tail, end)
        place = size - len(tail) + end
        if _U16 == n or _U32 in (length, start):
            sign, where = struct.unpack("<4s4xQ4x", read(place - 20, 20))
            if sign != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            n, length, start = struct.unpack("<32xQQQ", read(where, 56))
        self.members: dict[str, Member] = {}
        directory, at = read(start, length), 0
        for _ in range(n):
            sign, method, crc, packed, full, name, extra, comment, header = struct.unpack_from("<4s6xH4xIIIHHH8xI", directory, at)
            if sign != b"PK\1\2":
                raise ValueError("broken central directory")
            own = directory[at + 46 : at + 46 + name]
            more, m = directory[at + 46 + name : at + 46 + name + extra], 0
            while m + 4 <= len(more):
                tag, long = struct.unpack_from("<HH", more, m)
                if tag == 1:
                    wide = iter(struct.unpack_from(f"<{long // 8}Q", more, m + 4))
                    full = next(wide) if full == _U32 else full
                    packed = next(wide) if packed == _U32 else packed
                    header = next(wide) if header == _U32 else header
                m += 4 + long
            self.members[own.decode()] = Member(own.decode(), method, crc, packed, full, header)
            at += 46 + name + extra + comment

    def start(self, name: str) -> int:
        """Where the bytes of a stored member begin."""
        member = self.members[name]
        if member.method:
            raise ValueError(f"{name} is not stored")
        sign, long, extra = struct.unpack("<4s22xHH", self.read(member.header, 30))
        if sign != b"PK\3\4":
            raise ValueError("broken local header")
        return member.header + 30 + long + extra

    def member(self, name: str) -> bytes:
        data = self.read(self.start(name), self.members[name].size)
        if binascii.crc32(data) != self.members[name].crc:
            raise ValueError(f"{name} is damaged")
        return data


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record, which keeps the HTTP head and the digest but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": "sha1:" + digest(payload),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The WARC fields, the HTTP fields (both by lower-case name) and the payload that the record holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """Writes (page_id, url, html, refers_to) as packages into ``folder``; (path, records) of the packages of each task.

    A task that is run again writes new packages under other names; only those of the attempt that counts are listed.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index, n = io.BytesIO(), [], 0

        def close() -> pa.RecordBatch:
            files, base = storage(folder)
            files.create_dir(base, recursive=True)
            name = f"{uuid.uuid4().hex}.wacz"
            with files.open_output_stream(f"{base}/{name}") as out:
                write_package(out, [(DATA, data.getbuffer()), (INDEX, "".join(index).encode())])
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["path", "records"])

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(i) for i in range(4)), strict=True):
                page, url, html, refers = page.as_py(), url.as_py(), html.as_py(), refers.as_py()
                packed = zlib.compressobj(6, zlib.DEFLATED, 31)
                own = packed.compress(record(page, url, (html or "").encode(), refers)) + packed.flush()
                index.append(json.dumps({"page": page, "offset": data.tell(), "length": len(own)}) + "\n")
                data.write(own)
                n += 1
                if data.tell() >= PACKAGE_BYTES:
                    yield close()
                    data, index, n = io.BytesIO(), [], 0
        if n:
            yield close()

    return records.select("page_id", "url", "html", "refers_to").mapInArrow(write, "path string, records long")


def read_packages(packages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every record of the packages.

    The payload of a revisit is null, and its size and digest are those that the record states. The digest of a response
    is computed from what was read and must agree with the record.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: int(urn[10:-1]) if urn and urn[10:-1] else None
        for batch in batches:
            for path in batch.column("path"):
                files, base = storage(path.as_py())
                with files.open_input_file(base) as source:
                    package = Package(lambda start, length: source.read_at(length, start), source.size())  # noqa: B023
                    first = package.start(DATA)
                    found, room = [], 0
                    for line in package.member(INDEX).decode().splitlines():
                        entry = json.loads(line)
                        warc, http, payload = parse_record(zlib.decompress(source.read_at(entry["length"], first + entry["offset"]), 31))
                        stated, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
                        if kind == "response" and digest(payload) != stated:
                            raise ValueError(f"{path}: a payload is damaged")
                        payload = payload if kind == "response" else None
                        size = int(http["content-length"]) if payload is None else len(payload)
                        found.append((number(warc["warc-record-id"]), warc["warc-target-uri"], payload, size, stated, kind, number(warc.get("warc-refers-to"))))
                        room += size
                        if room >= 4 << 20 or len(found) >= 2000:
                            yield _rows(found)
                            found, room = [], 0
                    if found:
                        yield _rows(found)

    def _rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names)

    return packages.select("path").mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, html, refers_to): of pages with equal payloads of at least ``least`` bytes, all but the one with
    the smallest page_id refer to it.

    A null html is an empty payload. A page without page_id is never referred to, but may refer. Repeated rows of the
    smallest page_id are all responses.
    """
    payload = F.coalesce("html", F.lit(""))
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload.cast("binary")).alias("_sha"))
    long_enough = sized.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least)
    firsts = long_enough.groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null")
    firsts = written(firsts.select("_sha", "_first", "_n"), "warc-firsts")
    if firsts.limit(FIRSTS + 1).count() <= FIRSTS:
        joined = sized.join(F.broadcast(firsts), "_sha", "left")
    else:  # payloads of many pages do not meet in one task
        common = F.broadcast(firsts.where(F.col("_n") > COMMON))
        rest = sized.join(common.select("_sha"), "_sha", "left_anti").join(firsts.where(F.col("_n") <= COMMON), "_sha", "left")
        joined = sized.join(common, "_sha").unionByName(rest)
    refers = F.when((F.octet_length(F.coalesce("html", F.lit(""))) >= least) & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def archive(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes the pages as packages into the shared folder and returns the list of them, (path, records)."""
    return written(write_packages(with_revisits(pages, least), new_path(pages.sparkSession, "warc")), "warc-packages")


def archived_pages(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """What reading the archives of the pages back gives, without the payloads: a row for each page.

    A null html is an empty payload; a null url is an empty one; a page without page_id keeps null. Repeated rows are
    records of their own, all of them responses if they are the first of their payload. A very long html is one record,
    held by one task. An empty table gives an empty result; other columns go.
    """
    packages = archive(pages, least)
    return read_packages(packages.repartition(max(1, packages.count()))).drop("payload", "url")
