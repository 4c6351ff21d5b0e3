"""WARC records in ZIP packages: a writer, and a reader that never extracts.

A package is a ZIP file with stored members: archive/data.warc.gz (each record a gzip member of
its own, so it can be read alone) and indexes/index.cdxj (a line for each record with its
offset and length). The reader parses the end record, the ZIP64 end record and the central
directory, finds where the stored members lie, reads the index and then only the ranges of the
records asked for.

Packages are written to the folder that the session's executors share, under names of their
own attempt; the list of them is kept there too, so that an attempt that failed or was
repeated is never read.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.storage import shared_folder

#: Bytes of records in a package, and payload bytes from which equal ones are stored once.
PACKAGE_BYTES, REVISIT_BYTES = 16 << 20, 1000
#: Tasks that packages are read in at most.
TASKS = 1 << 16
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder's URI."""
    if "://" not in uri:
        path = uri.removeprefix("file:")
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(uri)


# -- records ------------------------------------------------------------------------------------


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(name: str | None) -> int | None:
    value = (name or "").removeprefix("<urn:page:").rstrip(">")
    return int(value) if value else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit (HTTP header only) of the page that has the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if revisit:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    page_id: int | None
    url: str | None
    kind: str
    refers_to: int | None
    digest: str
    payload_bytes: int
    payload: bytes | None


def parse_record(raw: bytes) -> Record:
    """Raises ValueError where lengths or the payload's digest don't agree with the headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sent = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode().split("\r\n")[1:])}
    size, digest, kind = int(sent["content-length"]), fields["warc-payload-digest"].partition(":")[2], fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    return Record(_id(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, _id(fields.get("warc-refers-to")) if kind == "revisit" else None, digest, size, payload if kind == "response" else None)


# -- packages -----------------------------------------------------------------------------------


def _gzip(raw: bytes) -> bytes:
    press = zlib.compressobj(3, zlib.DEFLATED, 31)
    return press.compress(raw) + press.flush()


class PackageWriter:
    """Collects records in memory, up to a package."""

    def __init__(self) -> None:
        self.data, self.lines = io.BytesIO(), []

    def add(self, page_id: int | None, raw: bytes) -> None:
        packed = _gzip(raw)
        self.lines.append(json.dumps({"page": page_id, "offset": self.data.tell(), "length": len(packed)}))
        self.data.write(packed)

    @property
    def size(self) -> int:
        return self.data.tell()

    def package(self, zip64: bool = True) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, content in ((DATA, self.data.getvalue()), (INDEX, ("\n".join(self.lines) + "\n").encode())):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as member:
                    member.write(content)
        return out.getvalue()


@dataclass
class Member:
    name: str
    method: int
    header: int
    packed: int
    size: int


class PackageReader:
    """Reads members of a ZIP file by ranges. source: an open file with read, seek and size."""

    def __init__(self, source) -> None:
        self.source, self.end = source, source.size()
        self.members = {m.name: m for m in self._directory()}

    def range(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        got = self.source.read(length)
        if len(got) != length:
            raise ValueError("the package ends early")
        return bytes(got)

    def _directory(self) -> list[Member]:
        """The central directory, which the end record or its ZIP64 form points to."""
        tail_at = max(0, self.end - 65557)
        tail = self.range(tail_at, self.end - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of a central directory")
        entries, size, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        if tail_at + at >= 20:
            locator = self.range(tail_at + at - 20, 20)
            if locator[:4] == b"PK\x06\x07":
                wide = self.range(struct.unpack("<Q", locator[8:16])[0], 56)
                if wide[:4] != b"PK\x06\x06":
                    raise ValueError("no ZIP64 end record where its locator points")
                entries, size, start = struct.unpack("<QQQ", wide[32:56])
        raw, out, p = self.range(start, size), [], 0
        for _ in range(entries):
            if raw[p : p + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            method, = struct.unpack("<H", raw[p + 10 : p + 12])
            packed, whole = struct.unpack("<II", raw[p + 20 : p + 28])
            n, extra, comment = struct.unpack("<HHH", raw[p + 28 : p + 34])
            header, = struct.unpack("<I", raw[p + 42 : p + 46])
            name = raw[p + 46 : p + 46 + n].decode()
            whole, packed, header = _wide_fields(raw[p + 46 + n : p + 46 + n + extra], whole, packed, header)
            out.append(Member(name, method, header, packed, whole))
            p += 46 + n + extra + comment
        return out

    def data_start(self, name: str) -> int:
        """Where a stored member's bytes begin: after its local header, whose lengths may differ."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} is not stored")
        local = self.range(m.header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("no local header where the directory points")
        n, extra = struct.unpack("<HH", local[26:30])
        return m.header + 30 + n + extra

    def index(self) -> list[dict]:
        raw = self.range(self.data_start(INDEX), self.members[INDEX].size)
        return [json.loads(line) for line in raw.decode().splitlines()]

    def record(self, start: int, entry: dict) -> Record:
        return parse_record(zlib.decompress(self.range(start + entry["offset"], entry["length"]), 31))

    def records(self) -> Iterator[Record]:
        if INDEX not in self.members or DATA not in self.members:
            return
        start = self.data_start(DATA)
        for entry in self.index():
            yield self.record(start, entry)


def _wide_fields(extra: bytes, *values: int) -> list[int]:
    """Sizes and offset, taken from the ZIP64 extra field where the directory has all ones."""
    p, wide = 0, b""
    while p + 4 <= len(extra):
        kind, n = struct.unpack("<HH", extra[p : p + 4])
        if kind == 1:
            wide = extra[p + 4 : p + 4 + n]
        p += 4 + n
    out = []
    for v in values:
        if v == 0xFFFFFFFF and len(wide) >= 8:
            v, wide = struct.unpack("<Q", wide[:8])[0], wide[8:]
        out.append(v)
    return out


# -- tables -------------------------------------------------------------------------------------


def decide(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to, revisit): of equal payloads of at least `least` bytes,
    the page with the largest id is stored, the others revisit it.

    Only ids and digests are grouped; the pages then join their decision by id and digest, so
    that a payload that very many pages share isn't gathered in one task."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("digest", F.sha1(payload)).withColumn("bytes", F.octet_length(payload))
    marks = rows.select("page_id", "digest", "bytes")
    keepers = marks.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"))
    decided = marks.where(F.col("bytes") >= least).distinct().join(keepers, "digest").where(~F.col("page_id").eqNullSafe(F.col("keeper"))).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("keeper").alias("refers_to"))
    joined = rows.join(decided, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    return joined.select("page_id", "url", "html", "digest", "refers_to", F.col("d").isNotNull().alias("revisit"))


def _write(folder: str, package_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        writer, n = PackageWriter(), 0

        def flush() -> pa.RecordBatch:
            name = f"{path}/{uuid.uuid4().hex}.wacz"
            with system.open_output_stream(name) as out:
                out.write(writer.package())
            return pa.RecordBatch.from_arrays([pa.array([name.removeprefix(path + "/")]), pa.array([n], pa.int64())], names=["name", "records"])

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "digest", "refers_to", "revisit")]
            for row in range(batch.num_rows):
                page_id, url, html, digest, refers_to, revisit = (c[row].as_py() for c in columns)
                writer.add(page_id, record(page_id, url, (html or "").encode(), digest, refers_to, revisit))
                n += 1
                if writer.size >= package_bytes:
                    yield flush()
                    writer, n = PackageWriter(), 0
        if n:
            yield flush()

    return run


def write_packages(pages: DataFrame, folder: str | None = None, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html; null html is empty) and returns the
    packages (folder, name, records), which are on disk by then."""
    shared = shared_folder(pages.sparkSession)
    folder = folder or f"{shared}/warc-{uuid.uuid4().hex}"
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    written = decide(pages).mapInArrow(_write(folder, package_bytes), "name string, records long").checkpoint()
    return written.select(F.lit(folder).alias("folder"), "name", "records")


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, name in zip(batch.column("folder").to_pylist(), batch.column("name").to_pylist()):
                system, path = open_folder(folder)
                with system.open_input_file(f"{path}/{name}") as source:
                    held: list[Record] = []
                    for got in PackageReader(source).records():
                        if not payloads:
                            got.payload = None
                        held.append(got)
                        if len(held) == 256:
                            yield _rows(held)
                            held = []
                    if held:
                        yield _rows(held)

    return run


def _rows(held: list[Record]) -> pa.RecordBatch:
    pick = lambda name, kind: pa.array([getattr(r, name) for r in held], kind)
    return pa.RecordBatch.from_arrays([pick("page_id", pa.int64()), pick("url", pa.string()), pick("kind", pa.string()), pick("refers_to", pa.int64()), pick("digest", pa.string()), pick("payload_bytes", pa.int64()), pick("payload", pa.binary())], names=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the packages (folder, name): page_id, url, record_type, refers_to,
    payload_digest, payload_bytes, and payload (null for revisits, or where not asked for).

    Packages without an index or an archive member have no records; damaged ones raise. Their names
    are dealt out to as many tasks as there are packages, up to TASKS: a number that is named stays
    as it is, where a few short rows would else be merged into one task that reads everything."""
    names = packages.select("folder", "name")
    return names.repartition(max(1, min(TASKS, names.count()))).mapInArrow(_read(payloads), "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")
