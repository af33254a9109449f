"""WARC archives as a Spark data source (operator 4).

Writing: every task writes archives of gzip members, one record each, and the
commit lists them in a manifest, so files of lost or repeated tasks are never
read. A member states its own length in an extra field, so a reader can step
over it. Equal payloads of ``MIN_REVISIT`` bytes or more are kept once: the
record with the largest ``page_id`` is the response, the others revisit it.

Reading: a file becomes several partitions at the offsets the writer noted.
Of every member the header is inflated and parsed first. Predicates on the
header's columns (equal, in, null or not, comparisons) are pushed down; a record
that fails one is stepped over, and the payload is inflated only if it is asked
for or to be verified. Archives of others (``.warc``, ``.warc.gz``) are read
whole, one partition a file; plain ones are stepped over by Content-Length.

A null payload counts as empty, a null page_id or url has no header. Repeated
rows of the leading page are all responses, as are rows of equal payloads that
have no page_id at all. Line ends in a url are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan,
    GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from callmetrics.llm.common import small_batches, table
from callmetrics.session import work_path

MIN_REVISIT = 0
FILE_BYTES = 256 << 20
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
SCHEMA = (
    "record_type string, page_id long, record_id string, target_uri string, date string, "
    "payload_digest string, payload_bytes long, refers_to long, payload binary"
)
_PAGE = "urn:page:"


# ---- records -------------------------------------------------------------


def base32_of(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{name}: {value}" for name, value in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(content: bytes, level: int = 5) -> bytes:
    """A gzip member whose extra field SL holds its whole length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(content) + packer.flush()
    size = 10 + 2 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHI", 8, b"SL", 4, size)
    return head + body + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A response with an HTTP head and the payload, or a revisit with the head alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Date", DATE)]
    headers.append(("WARC-Record-ID", f"<{_PAGE}{page_id}>" if page_id is not None else f"<{uuid.uuid4().urn}>"))
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        headers += [
            ("WARC-Refers-To", f"<{_PAGE}{refers_to}>"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    headers.append(("Content-Type", "application/http;msgtype=response"))
    return record(headers, http if revisit else http + payload)


def _page_of(urn: str | None) -> int | None:
    name = (urn or "").strip("<>")
    return int(name[len(_PAGE):]) if name.startswith(_PAGE) else None


def parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:]) if name}


# ---- files ---------------------------------------------------------------


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme by which Spark itself would read it. The archive
    source runs in Python workers, which don't know the cluster's default file
    system: to them a path without a scheme is a local file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file:///") else found


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Window:
    """Forward reads of one file in large steps."""

    def __init__(self, file, start: int):
        self.file, self.start, self.data = file, start, b""

    def take(self, at: int, size: int) -> bytes:
        """Up to ``size`` bytes from ``at`` on."""
        if not self.start <= at <= self.start + len(self.data):
            self.start, self.data = at, b""
        elif at - self.start > READ_BYTES:
            self.start, self.data = at, self.data[at - self.start:]
        missing = at + size - self.start - len(self.data)
        if missing > 0:
            self.file.seek(self.start + len(self.data))
            self.data += self.file.read(max(missing, READ_BYTES))
        return self.data[at - self.start:at - self.start + size]


class Inflated:
    """Content of one gzip member, inflated as far as it is asked for."""

    def __init__(self, window: Window, at: int):
        self.window, self.at = window, at
        self.packer = zlib.decompressobj(31)
        self.content, self.waiting = b"", b""

    def upto(self, size: int) -> bytes:
        while len(self.content) < size and not self.packer.eof:
            if not self.waiting:
                self.waiting = self.window.take(self.at, 1 << 16)
                self.at += len(self.waiting)
                if not self.waiting:
                    raise ValueError("archive ends inside a record")
            self.content += self.packer.decompress(self.waiting, max(size - len(self.content), 1 << 12))
            self.waiting = self.packer.unconsumed_tail
        return self.content

    def end(self) -> int:
        """Offset behind the member."""
        while not self.packer.eof:
            self.upto(len(self.content) + (1 << 20))
        return self.at - len(self.packer.unused_data)


class Plain:
    """A record that is not compressed."""

    def __init__(self, window: Window, at: int):
        self.window, self.at = window, at

    def upto(self, size: int) -> bytes:
        return self.window.take(self.at, size)


def _header(source) -> tuple[dict[str, str], int] | None:
    """The parsed header and where the block begins."""
    size = 1 << 10
    while True:
        head = source.upto(size)
        cut = head.find(b"\r\n\r\n")
        if cut >= 0:
            return parsed(head[:cut]), cut + 4
        if len(head) < size:
            return None
        size *= 2


def records(file, start: int, end: int, wanted) -> Iterator[tuple[dict[str, str], callable]]:
    """Headers that ``wanted`` accepts, each with a function that gives the block."""
    window = Window(file, start)
    at = start
    while at < end:
        opening = window.take(at, 20)
        if not opening.strip(b"\r\n"):
            if len(opening) < 20:
                return
            at += len(opening)
            continue
        if opening[:1] in b"\r\n":
            at += len(opening) - len(opening.lstrip(b"\r\n"))
            continue
        packed = opening[:2] == b"\x1f\x8b"
        source = Inflated(window, at) if packed else Plain(window, at)
        found = _header(source)
        if found is None:
            return
        headers, block = found
        size = int(headers.get("content-length", 0))
        if wanted(headers):
            yield headers, lambda source=source, block=block, size=size: source.upto(block + size)[block:block + size]
        if not packed:
            at += block + size + 4
        elif opening[3] & 4 and opening[12:14] == b"SL":
            at += struct.unpack("<I", opening[16:20])[0]
        else:
            at = source.end()


# ---- the data source -----------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int


class WarcWriter(DataSourceArrowWriter):
    """Columns page_id, url, payload (binary), sha1 (hex), refers_to."""

    def __init__(self, options):
        self.path = options["path"]
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _files(self.path)
        system.create_dir(folder, recursive=True)
        done: list[dict] = []
        out = None
        info = member(record([
            ("WARC-Type", "warcinfo"), ("WARC-Date", DATE), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"),
            ("Content-Type", "application/warc-fields"),
        ], b"format: WARC File Format 1.1\r\n"))
        try:
            for batch in iterator:
                for row in zip(*[batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "sha1", "refers_to")]):
                    page_id, url, payload, sha1, refers_to = (value.as_py() for value in row)
                    payload = payload or b""
                    entry = member(page_record(page_id, url, payload, base32_of(sha1), len(payload), refers_to))
                    if out is None:
                        done.append({"name": f"part-{uuid.uuid4().hex}.warc.gz", "size": len(info), "splits": [0]})
                        out = io.BufferedWriter(system.open_output_stream(f"{folder}/{done[-1]['name']}", compression=None), READ_BYTES)
                        out.write(info)
                    file = done[-1]
                    if file["size"] - file["splits"][-1] >= self.split_bytes:
                        file["splits"].append(file["size"])
                    out.write(entry)
                    file["size"] += len(entry)
                    if file["size"] >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _files(self.path)
        system.create_dir(folder, recursive=True)
        files = [file for message in messages if message for file in message.files]
        with system.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files without a manifest entry are never read."""


_COLUMNS = {
    "record_type": lambda h: h.get("warc-type"),
    "page_id": lambda h: _page_of(h.get("warc-record-id")),
    "record_id": lambda h: h.get("warc-record-id", "").strip("<>") or None,
    "target_uri": lambda h: h.get("warc-target-uri"),
    "date": lambda h: h.get("warc-date"),
    "payload_digest": lambda h: h["warc-payload-digest"].rpartition(":")[2] if "warc-payload-digest" in h else None,
    "refers_to": lambda h: _page_of(h.get("warc-refers-to")),
}

_TESTS = {
    EqualTo: lambda found, value: found is not None and found == value,
    EqualNullSafe: lambda found, value: found == value,
    GreaterThan: lambda found, value: found is not None and found > value,
    GreaterThanOrEqual: lambda found, value: found is not None and found >= value,
    LessThan: lambda found, value: found is not None and found < value,
    LessThanOrEqual: lambda found, value: found is not None and found <= value,
    In: lambda found, value: found is not None and found in value,
    IsNull: lambda found, _: found is None,
    IsNotNull: lambda found, _: found is not None,
}


class WarcReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path = options["path"]
        self.columns = schema.names
        self.verify = options.get("verify", "false").lower() == "true"
        self.filters: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            column = one.attribute[0] if getattr(one, "attribute", None) and len(one.attribute) == 1 else None
            if type(one) in _TESTS and column in _COLUMNS:
                self.filters.append((type(one), column, getattr(one, "value", None)))
            else:
                yield one

    def partitions(self) -> list[Stretch]:
        system, folder = _files(self.path)
        found = system.get_file_info(fs.FileSelector(folder))
        manifests = [f for f in found if f.base_name.startswith("_manifest-")]
        if not manifests:
            return [Stretch(f.path, 0, f.size) for f in found if f.base_name.endswith((".warc", ".warc.gz"))]
        parts = []
        for manifest in manifests:
            with system.open_input_stream(manifest.path) as listed:
                for file in json.loads(listed.read()):
                    edges = [*file["splits"], file["size"]]
                    parts += [Stretch(f"{folder}/{file['name']}", a, b) for a, b in zip(edges, edges[1:])]
        return parts

    def _wanted(self, headers: dict[str, str]) -> bool:
        return all(_TESTS[kind](_COLUMNS[column](headers), value) for kind, column, value in self.filters)

    def _row(self, headers: dict[str, str], block) -> tuple:
        row = {name: get(headers) for name, get in _COLUMNS.items() if name in self.columns}
        kept = headers.get("warc-type") == "response"
        if "payload_bytes" in self.columns or "payload" in self.columns or self.verify:
            # The HTTP head is small and gives the payload's size even for a revisit.
            content = block() if kept and ("payload" in self.columns or self.verify) else None
            head, _, payload = (content if content is not None else block()).partition(b"\r\n\r\n")
            size = parsed(head).get("content-length") if headers.get("content-type", "").startswith("application/http") else None
            row["payload_bytes"] = len(payload) if content is not None else int(size) if size else None
            row["payload"] = payload if content is not None else None
            if self.verify and kept:
                if base64.b32encode(hashlib.sha1(payload).digest()).decode() != _COLUMNS["payload_digest"](headers):
                    raise ValueError(f"payload of {headers.get('warc-record-id')} does not have its digest")
        return tuple(row.get(name) for name in self.columns)

    def read(self, partition: Stretch | None) -> Iterator[tuple]:
        if partition is None:  # there are no archives
            return
        system, _ = _files(self.path)
        with system.open_input_file(partition.path) as file:
            for headers, block in records(file, partition.start, partition.end, self._wanted):
                yield self._row(headers, block)


class Warc(DataSource):
    """``format("warc")``; options path, verify, file_bytes, split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


# ---- operator ------------------------------------------------------------


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known; its reader takes pushed predicates."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to) of (page_id, url, html). Leaders
    are found from digests alone and pre-aggregated, however many copies a
    payload has."""
    rows = small_batches(pages).select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    ).withColumn("sha1", F.sha1("payload"))
    leaders = (
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1")
        .agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "leader")
    )
    other = F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader"))
    return rows.join(leaders, "sha1", "left").select(
        "page_id", "url", "payload", "sha1", F.when(other, F.col("leader")).alias("refers_to")
    )


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, then read the archives back; see the module for the method."""
    register(spark)
    path = qualified(spark, work_path(spark, "warc"))
    with_revisits(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    return (
        spark.read.format("warc").schema("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
        .option("verify", "true").load(path).where(F.col("record_type").isin("response", "revisit"))
    )
