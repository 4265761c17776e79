"""WARC archives in seekable Zstandard bundles.

A bundle is a .warc.zst file of independent frames, each with some whole records, and ends with the seek
table of the Zstandard seekable format: a skippable frame with the packed and the plain size of every
frame. The index maps a record to bundle, frame, offset within the plain frame and length, so one record
costs one range read and one frame.

Of records with equal payloads of at least ``REVISIT_BYTES`` the one of largest id is a response and the
others are revisits that refer to it; smaller payloads are always responses.

Defined cases: NULL html is an empty payload; NULL ids are less than all others; rows that repeat the
largest id are all responses; NULL or odd urls are written percent-encoded; a payload over the frame size is
a frame alone; an empty table writes nothing. Other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.store import open_file, put_bytes, shared_folder, small, written

REVISIT_BYTES = 1000
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 26
#: Fixed values of the seekable format and of the WARC profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX = "page string, record_id string, path string, frame bigint, offset bigint, length bigint"


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, payload, payload_bytes, digest, refers_to): refers_to is set for revisits."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn(
        "payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    shared = written(rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("digest").agg(
        F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "equal-payloads")
    other = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(small(shared), "digest", "left").select(
        "id", "url", "payload", "payload_bytes", "digest", other.alias("refers_to"))


def _record_id(key, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{json.dumps(key)} {digest}')}>"


def _record(key, url: str | None, payload: bytes, digest: str, refers_to) -> tuple[str, bytes]:
    record_id = _record_id(key, digest)
    target = urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else "urn:none"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Page: {json.dumps(key)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {json.dumps(refers_to)}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return record_id, "\r\n".join(head).encode() + block + b"\r\n\r\n"


@dataclass
class _Bundle:
    """Frames that are packed, the records of the open frame, and the index entries of both."""

    frames: list[tuple[bytes, int]] = field(default_factory=list)
    open: list[bytes] = field(default_factory=list)
    open_bytes: int = 0
    size: int = 0
    entries: list[tuple[str, str, int, int, int]] = field(default_factory=list)

    def add(self, page: str, record_id: str, data: bytes) -> None:
        if self.open and self.open_bytes + len(data) > FRAME_BYTES:
            self.pack()
        self.entries.append((page, record_id, len(self.frames), self.open_bytes, len(data)))
        self.open.append(data)
        self.open_bytes += len(data)

    def pack(self) -> None:
        if self.open:
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(self.open))
            self.frames.append((packed, self.open_bytes))
            self.size += len(packed)
            self.open, self.open_bytes = [], 0

    def bytes(self) -> bytes:
        self.pack()
        table = b"".join(struct.pack("<II", len(p), n) for p, n in self.frames)
        foot = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join([*(p for p, _ in self.frames), struct.pack("<II", SKIPPABLE, len(table) + len(foot)), table, foot])


def _archived(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bundle = TaskContext.get().partitionId(), _Bundle()

        def close() -> pa.RecordBatch:
            path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.warc.zst"
            put_bytes(path, bundle.bytes())
            pages, ids, frames, offsets, lengths = zip(*bundle.entries, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(pages), pa.array(ids), pa.array([path] * len(ids)), pa.array(frames, pa.int64()), pa.array(offsets, pa.int64()),
                 pa.array(lengths, pa.int64())], names=["page", "record_id", "path", "frame", "offset", "length"])

        for batch in batches:
            for i in range(batch.num_rows):
                key, url, payload, digest, refers_to = (batch.column(c)[i].as_py() for c in range(5))
                bundle.add(json.dumps(key), *_record(key, url, payload, digest, refers_to))
                if bundle.size >= BUNDLE_BYTES:
                    yield close()
                    bundle = _Bundle()
        if bundle.entries:
            yield close()
    return run


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row to bundles in ``folder``; returns the index (INDEX). Ids must be of a type that JSON holds.

    A bundle's name holds a random part and the index names the bundles of successful tasks only, so what a
    lost task left behind is never read.
    """
    rows = with_revisits(pages, id_col, url_col, html_col).select("id", "url", "payload", "digest", "refers_to")
    return written(rows.mapInArrow(_archived(folder), INDEX), "warc-index")


def seek_table(source: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(offset, packed size, plain size) of every frame, from the end of an open bundle."""
    size = source.size()
    source.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    source.seek(size - 9 - n * width)
    table, at, out = source.read(n * width), 0, []
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def _frame(source: pa.NativeFile, entry: tuple[int, int, int]) -> bytes:
    source.seek(entry[0])
    return zstandard.ZstdDecompressor().decompress(source.read(entry[1]), max_output_size=entry[2])


def fetch(path: str, frame: int, offset: int, length: int) -> bytes:
    """The bytes of one record, by its index entry; other frames are not read."""
    with open_file(path) as source:
        return _frame(source, seek_table(source)[frame])[offset:offset + length]


def parse(plain: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of the records in a plain frame."""
    at = 0
    while at < len(plain):
        stop = plain.index(b"\r\n\r\n", at)
        version, *lines = plain[at:stop].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines)
        end = stop + 4 + int(headers["Content-Length"])
        yield headers, plain[stop + 4:end]
        at = end + 4


def _read(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        kinds = [kind, pa.int64(), pa.string(), pa.string(), kind, pa.string()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_file(path) as source:
                    for entry in seek_table(source):
                        rows = []
                        for headers, block in parse(_frame(source, entry)):
                            http, _, payload = block.partition(b"\r\n\r\n")
                            size = int(http.rpartition(b"Content-Length: ")[2])
                            digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                            if headers["WARC-Type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                                raise ValueError(f"{headers['WARC-Record-ID']} in {path} is damaged")
                            target = headers["WARC-Target-URI"]
                            rows.append((json.loads(headers["X-Page"]), size, digest, headers["WARC-Type"],
                                         json.loads(headers.get("X-Refers-To-Page", "null")), None if target == "urn:none" else target))
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    return run


def read_bundles(index: DataFrame, id_type: str = "bigint") -> DataFrame:
    """A row per record of the bundles that ``index`` names: id, payload_bytes, payload_digest, record_type, refers_to, url."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    paths = index.select("path").distinct()
    run = _read(to_arrow_type(_parse_datatype_string(id_type)))
    return paths.repartition(max(1, paths.count())).mapInArrow(
        run, f"id {id_type}, payload_bytes bigint, payload_digest string, record_type string, refers_to {id_type}, url string")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Write ``pages`` and read the archives back."""
    index = write_bundles(pages, folder or shared_folder(pages.sparkSession, "warc"), id_col, url_col, html_col)
    return read_bundles(index, pages.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col)
