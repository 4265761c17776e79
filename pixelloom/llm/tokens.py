"""Token ids of documents in Huffman-coded files.

Texts are tokenized once and their ids kept in a table. Ids are counted over the whole corpus, one canonical
length-limited code is made from the counts, and the table is dealt into ascending document order by range
and coded there. A file is

    "PXH1", u32 bytes of the header, header (JSON: limit, check, symbols), u32 bytes of the code lengths,
    code lengths (zlib, one byte a symbol), blocks, footer (JSON), u32 bytes of the footer

with offset, bytes and documents of every block in the footer. A block holds whole texts and can be decoded
alone: u32 documents, u32 checkpoints, u64 bytes; the documents' numbers of ids (u64 each); their bytes (u64
each); per checkpoint its bit offset in its text (u32); the bytes. The documents' ids are kept as JSON in the
block's footer entry. Blocks are written as they are closed, so a task holds one block and never a file.

Defined cases: NULL text has no ids but the end id; NULL ids come first; rows of equal id follow each other
in any order; a text of any length is one stretch of bytes; an empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm import huffman
from pixelloom.llm.store import create_file, narrow_batches, open_file, shared_folder, written
from pixelloom.llm.wordids import WordIds

END_ID = 1
#: Ids and bytes of a block, and bytes of a file, are closed at the first text that reaches them.
BLOCK_IDS, FILE_BYTES = 1 << 18, 1 << 27
#: Bytes of texts, and of ids, that a task works on at a time.
_TEXT_SLICE, _ID_SLICE = 4 << 20, 1 << 18
#: Bytes of an Arrow batch that Spark hands to a task.
_BATCH = 8 << 20


def _slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``size`` bytes of ``column``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // size, prepend=0, append=-1))
    at = 0
    for cut in [*cuts.tolist(), batch.num_rows]:
        if cut > at:
            yield batch.slice(at, cut - at)
            at = cut


def _dtype(path: str) -> str:
    return "<u2" if WordIds(path).size <= 1 << 16 else "<u4"


def _tokenized(path: str, end: int | None, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        for batch in batches:
            for part in _slices(batch, 1, _TEXT_SLICE):
                ids, sizes = words.encode(part.column(1))
                if end is not None:
                    ids = np.insert(ids, np.cumsum(sizes), end)
                    sizes = sizes + 1
                raw, width = ids.astype(dtype), np.dtype(dtype).itemsize
                cuts = np.concatenate([[0], np.cumsum(sizes)]) * width
                # the low and the high bytes of a text apart, which pack better
                offsets = cuts.astype(np.int64)
                flat = raw.view(np.uint8).reshape(-1, width)
                planes = np.empty(len(raw) * width, dtype=np.uint8)
                for i in range(len(sizes)):
                    a, b = offsets[i], offsets[i + 1]
                    planes[a:b] = flat[a // width:b // width].T.ravel()
                column = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(planes)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), column], names=["id", "n", "ids"])
                pa.default_memory_pool().release_unused()
    return run


def _ids(column: pa.Array, dtype: str) -> list[np.ndarray]:
    width = np.dtype(dtype).itemsize
    return [np.ascontiguousarray(np.frombuffer(x, dtype=np.uint8).reshape(width, -1).T).view(dtype).ravel() for x in column.to_pylist()]


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int | None = END_ID) -> DataFrame:
    """(id, n, ids): the ids of each text, as bytes in planes."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_tokenized(path, end, _dtype(path)), f"id {kind}, n bigint, ids binary")


def id_counts(table: DataFrame, size: int, dtype: str) -> np.ndarray:
    """How often each id occurs; at most ``size`` rows, the vocabulary, reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for part in _slices(batch, 0, _ID_SLICE):
                parts = _ids(part.column(0), dtype)
                total += np.bincount(np.concatenate(parts), minlength=size) if parts else 0
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["symbol", "n"])

    counts = np.zeros(size, dtype=np.int64)
    for row in table.select("ids").mapInArrow(count, "symbol bigint, n bigint").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        counts[row["symbol"]] = row["n"]
    return counts


def _coded(code: huffman.Code, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = code.codes()
        for batch in batches:
            for part in _slices(batch, 2, _ID_SLICE):
                ids = _ids(part.column(2), dtype)
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                data, n_bytes, checks = huffman.encode(words, code, np.concatenate(ids) if ids else np.zeros(0, dtype), sizes)
                ends, check_ends = np.cumsum(n_bytes), np.cumsum(-(-sizes // huffman.CHECK))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1),
                    pa.array([x.tobytes() for x in np.split(data, ends[:-1])], pa.binary()),
                    pa.array([x.tobytes() for x in np.split(checks, check_ends[:-1])], pa.binary())], names=["id", "n", "data", "checks"])
    return run


class _FileWriter:
    """Collects texts into blocks and writes these to one file."""

    def __init__(self, path: str, code: huffman.Code):
        head = json.dumps({"limit": code.limit, "check": huffman.CHECK, "symbols": len(code.lengths)}).encode()
        lengths = zlib.compress(code.lengths.tobytes())
        self.path, self.out, self.size = path, create_file(path), 0
        self.blocks, self.texts, self.ids = [], [], 0
        self._write(b"PXH1", np.uint32(len(head)).tobytes(), head, np.uint32(len(lengths)).tobytes(), lengths)

    def _write(self, *parts: bytes) -> int:
        size = 0
        for part in parts:
            self.out.write(part)
            size += len(part)
        self.size += size
        return size

    def add(self, key, n: int, data: bytes, checks: bytes) -> None:
        self.texts.append((key, n, data, checks))
        self.ids += n
        if self.ids >= BLOCK_IDS:
            self.close_block()

    def close_block(self) -> None:
        if self.texts:
            keys, n, data, checks = zip(*self.texts, strict=True)
            at = self.size
            size = self._write(
                np.uint32(len(keys)).tobytes(), np.uint32(sum(map(len, checks)) // 4).tobytes(), np.uint64(sum(map(len, data))).tobytes(),
                np.array(n, "<u8").tobytes(), np.array([len(x) for x in data], "<u8").tobytes(), *checks, *data)
            self.blocks.append({"offset": at, "bytes": size, "ids": self.ids, "keys": keys})
            self.texts, self.ids = [], 0

    def close(self, part: int, number: int) -> pa.RecordBatch:
        """Finish the file; returns its row of the index."""
        self.close_block()
        foot = json.dumps({"blocks": self.blocks}).encode()
        self._write(foot, np.uint32(len(foot)).tobytes())
        self.out.close()
        ids, texts = sum(b["ids"] for b in self.blocks), sum(len(b["keys"]) for b in self.blocks)
        return pa.RecordBatch.from_arrays(
            [pa.array([x]) for x in (part, number, self.path, ids, texts)], names=["part", "number", "path", "n_ids", "n_texts"])


def _filed(folder: str, code: huffman.Code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for key, n, data, checks in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                out = out or _FileWriter(f"{folder}/{part:06d}-{number:04d}-{uuid.uuid4().hex}.pxh", code)
                out.add(key, n, data, checks)
                if out.size >= FILE_BYTES:
                    yield out.close(part, number)
                    number, out = number + 1, None
        if out:
            yield out.close(part, number)
    return run


def write_ids(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end: int | None = END_ID) -> DataFrame:
    """Write the ids of all texts to files in ``folder``; returns one row per file: part, number, path, n_ids, n_texts, start.

    Files in order of (part, number) hold the documents in ascending id order; ``start`` is the number of
    ids in the files before. The id column must be of a type that JSON holds, such as a number or a string.
    """
    dtype = _dtype(path)
    with narrow_batches(docs.sparkSession, _BATCH):
        table = written(tokenized(docs, path, id_col, text_col, end), "token-ids", "zstd")
        code = huffman.Code.of_counts(id_counts(table, WordIds(path).size, dtype))
        coded, filed, order = _coded(code, dtype), _filed(folder, code), F.col("id").asc_nulls_first()
        dealt = table.repartitionByRange(order).sortWithinPartitions(order)
        files = written(dealt.mapInArrow(lambda batches: filed(coded(batches)), "part bigint, number bigint, path string, n_ids bigint, n_texts bigint"), "token-files")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _opened(path: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The blocks of a file: document ids, and the token ids of each."""
    with open_file(path) as source:
        size = source.size()
        source.seek(size - 4)
        length = int(np.frombuffer(source.read(4), "<u4")[0])
        source.seek(size - 4 - length)
        blocks = json.loads(source.read(length))["blocks"]
        source.seek(0)
        if source.read(4) != b"PXH1":
            raise ValueError(f"{path} is not a file of token ids")
        head = json.loads(source.read(int(np.frombuffer(source.read(4), "<u4")[0])))
        lengths = zlib.decompress(source.read(int(np.frombuffer(source.read(4), "<u4")[0])))
        code = huffman.Code(np.frombuffer(lengths, np.uint8), head["limit"])
        table = code.table()
        for block in blocks:
            source.seek(block["offset"])
            raw = source.read(block["bytes"])
            texts, marks = (int(x) for x in np.frombuffer(raw, "<u4", 2))
            n, n_bytes = np.frombuffer(raw, "<u8", 2 * texts, 16).astype(np.int64).reshape(2, texts)
            checks = np.frombuffer(raw, "<u4", marks, 16 + 16 * texts).astype(np.int64)
            data = np.frombuffer(raw, np.uint8, -1, 16 + 16 * texts + 4 * marks)
            stretches = -(-n // head["check"])
            byte_starts = np.concatenate([[0], np.cumsum(n_bytes)[:-1]])
            counts = np.full(marks, head["check"], dtype=np.int64)
            last = np.cumsum(stretches)[n > 0] - 1
            counts[last] = (n[n > 0] - 1) % head["check"] + 1
            ids = huffman.decode(table, code, data, checks + np.repeat(byte_starts * 8, stretches), counts)
            yield block["keys"], np.split(ids, np.cumsum(n)[:-1])


def _read(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for keys, texts in _opened(path):
                    sizes = np.array([len(x) for x in texts], dtype=np.int64)
                    begins = start + np.concatenate([[0], np.cumsum(sizes)])
                    start = int(begins[-1])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys, kind), pa.array(begins[:-1], pa.int64()), pa.array(sizes, pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in texts], pa.int64()),
                        pa.array([x.astype("<u4").tobytes() for x in texts], pa.binary())], names=["id", "start", "n_tokens", "crc", "ids"])
    return run


def _without_ids(run):
    return lambda batches: (x.select(["id", "start", "n_tokens", "crc"]) for x in run(batches))


def read_ids(files: DataFrame, id_type: str, ids: bool = False) -> DataFrame:
    """Decode the files: id, start, n_tokens, crc (CRC-32 of the ids as little-endian u32), and with ``ids`` those bytes."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    run = _read(to_arrow_type(_parse_datatype_string(id_type)))
    many = max(1, files.count())
    paths = files.select("path", "start").repartition(many)
    schema = f"id {id_type}, start bigint, n_tokens bigint, crc bigint"
    return paths.mapInArrow(run, f"{schema}, ids binary") if ids else paths.mapInArrow(_without_ids(run), schema)


def token_output(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write ``docs`` to files and read them back: id, start, n_tokens, ids_crc32."""
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    files = write_ids(docs, path, folder, id_col, text_col)
    back = read_ids(files, docs.schema[id_col].dataType.simpleString())
    return back.select(F.col("id").alias(id_col), "start", "n_tokens", F.col("crc").alias("ids_crc32"))
