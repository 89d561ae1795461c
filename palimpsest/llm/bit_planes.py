"""Token-ID output (operator 7): blocks of ids, transposed into bit planes, each compressed with zstandard.

File: MAGIC, then chunks, then the index, its length in eight bytes, MAGIC. A chunk holds BLOCK ids (the last one fewer):
a byte for the planes present, then for each plane from the lowest bit its length in four bytes and its zstandard frame. Among them
stand chunks of up to BLOCK documents: planes of the low and of the high halves of their doc_ids, and of their lengths, each after its size in four
bytes. The index (JSON, compressed) has the place, first id and ids of each chunk of ids, and the place and documents of the others.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import common, tokens

MAGIC, BLOCK, LEVEL, END = b"BITPLANE", 1 << 16, 3, 1


def encode_planes(ids: np.ndarray) -> bytes:
    """Up to 32 planes of unsigned 32-bit ids; planes above the highest bit in use are left out."""
    packer = zstandard.ZstdCompressor(level=LEVEL)
    n = int(ids.max()).bit_length() if len(ids) else 0
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    planes = [packer.compress(np.packbits(bits[:, k]).tobytes()) for k in range(n)]
    return bytes([n]) + b"".join(len(p).to_bytes(4, "little") + p for p in planes)


def decode_planes(data: bytes, count: int) -> np.ndarray:
    unpacker = zstandard.ZstdDecompressor()
    bits, at = np.zeros((count, 32), np.uint8), 1
    for k in range(data[0]):
        size = int.from_bytes(data[at : at + 4], "little")
        bits[:, k] = np.unpackbits(np.frombuffer(unpacker.decompress(data[at + 4 : at + 4 + size]), np.uint8), count=count)
        at += 4 + size
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Ids of documents one after another; holds a block of ids and a block of documents at most, beside what a document brings."""

    def __init__(self, sink):
        self.sink, self.at, self.ids, self.docs, self.pending = sink, 0, 0, 0, b""
        self.chunks: list[tuple[int, int, int]] = []
        self.groups: list[tuple[int, int]] = []
        self.doc_ids: list[int] = []
        self.lengths: list[int] = []
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.docs += 1
        if len(self.doc_ids) == BLOCK:
            self._group()
        self.pending += ids
        whole = len(self.pending) // (4 * BLOCK) * 4 * BLOCK
        for at in range(0, whole, 4 * BLOCK):
            self._chunk(self.pending[at : at + 4 * BLOCK])
        if whole:
            self.pending = self.pending[whole:]

    def _chunk(self, raw: bytes) -> None:
        data = encode_planes(np.frombuffer(raw, "<u4"))
        self.chunks.append((self.at, self.ids, len(raw) // 4))
        self._write(data)
        self.ids += len(raw) // 4

    def _group(self) -> None:
        halves = np.array(self.doc_ids, "<i8").view("<u4").reshape(-1, 2)
        self.groups.append((self.at, len(self.doc_ids)))
        for part in (halves[:, 0], halves[:, 1], np.array(self.lengths, "<u4")):
            data = encode_planes(np.ascontiguousarray(part))
            self._write(len(data).to_bytes(4, "little") + data)
        self.doc_ids, self.lengths = [], []

    def close(self) -> None:
        if self.pending:
            self._chunk(self.pending)
        if self.doc_ids:
            self._group()
        index = {"chunks": self.chunks, "groups": self.groups, "ids": self.ids, "docs": self.docs}
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(json.dumps(index).encode())
        self._write(packed + len(packed).to_bytes(8, "little") + MAGIC)


def read_index(source, size: int) -> dict:
    source.seek(size - 16)
    tail = source.read(16)
    source.seek(0)
    if tail[8:] != MAGIC or source.read(8) != MAGIC:
        raise ValueError("not a whole bit-plane file")
    n = int.from_bytes(tail[:8], "little")
    source.seek(size - 16 - n)
    return json.loads(zstandard.ZstdDecompressor().decompress(source.read(n)))


def read_chunk(source, chunk: tuple[int, int, int]) -> bytes:
    """The ids of one chunk of the index."""
    at, _, count = chunk
    source.seek(at)
    data = source.read(1)
    for _ in range(data[0]):
        size = source.read(4)
        data += size + source.read(int.from_bytes(size, "little"))
    return decode_planes(data, count).tobytes()


def _listed(source, index: dict) -> Iterator[tuple[int, int]]:
    """(doc_id, length), a block of documents in memory."""
    for at, count in index["groups"]:
        source.seek(at)
        parts = [decode_planes(source.read(int.from_bytes(source.read(4), "little")), count) for _ in range(3)]
        yield from zip(np.stack(parts[:2], 1).view("<i8").ravel().tolist(), parts[2].tolist(), strict=True)


def read_documents(source, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(doc_id, start in the file, ids); holds the chunks that one document lies in."""
    index = read_index(source, size)
    held, at, k, start = b"", 0, 0, 0  # at: where in held the next document begins
    for doc_id, length in _listed(source, index):
        parts, have = [held[at:]], len(held) - at
        while have < 4 * length:
            parts.append(read_chunk(source, index["chunks"][k]))
            k, have = k + 1, have + len(parts[-1])
        if len(parts) > 1:
            held, at = b"".join(parts), 0
        yield doc_id, start, held[at : at + 4 * length]
        at, start = at + 4 * length, start + length


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> DataFrame:
    """Writes doc_id, text (null: empty) in ascending doc_id order; gives (file string, part int, docs long, ids long, bytes long).

    Part k's documents come before part k+1's. A task writes under a name of its own and renames it when whole, so
    a task that runs again or twice leaves the same files. folder: a URI that every executor reaches.
    """
    path = path or tokens.vocabulary("word_bpe_49k.json")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = common.texts(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name, own = f"{root}/part-{part:06d}.planes", f"{root}/.{part:06d}-{uuid.uuid4().hex}"
        coder, tail = tokens.white_space_free_coder(path), end.to_bytes(4, "little")
        writer = sink = None
        for batch in batches:
            for i, ids in tokens.coded(coder, batch):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(own)
                    writer = Writer(sink)
                writer.add(i, ids + tail)
        if writer is not None:
            writer.close()
            sink.close()
            store.move(own, name)
            yield pa.RecordBatch.from_pydict({"file": [os.path.basename(name)], "part": [part], "docs": [writer.docs], "ids": [writer.ids], "bytes": [writer.at]}, schema=schema)

    return ordered.mapInArrow(write, "file string, part int, docs long, ids long, bytes long")


def read_ids(spark: SparkSession, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from files of (name, ids before its first), a task for each."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as source:
                    rows: list[tuple] = []
                    for i, start, ids in read_documents(source, source.size()):
                        rows.append((i, base + start, len(ids) // 4, zlib.crc32(ids)))
                        if len(rows) == 10_000:
                            yield _rows(rows, schema)
                            rows = []
                    if rows:
                        yield _rows(rows, schema)

    listed = spark.createDataFrame(files or [("", 0)], "file string, base long").where("file <> ''")
    listed = listed.repartition(max(1, len(files)))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(schema.names)}, schema=schema)


def op7_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read from the files. A row for each file, not document, is seen by the driver."""
    folder = common.shared_folder(spark)
    parts = write_ids(common.documents(spark, sf_dir), folder).select("part", "file", "ids").collect()
    files, base = [], 0
    for _, name, ids in sorted(parts):
        files.append((name, base))
        base += ids
    return read_ids(spark, folder, files)
