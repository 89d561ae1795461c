"""Captures of web pages as a data source: folders of JSON lines, written all or not at all, read line by line with a reason for each that can't be used.

    captures.register(spark)
    df.write.format("captures").mode("append").save(folder)
    good, refused = captures.split(spark.read.format("captures").load(folder))

A line is a capture, or a baseline: a capture with words around it, as people keep it. Folders are anything that pyarrow.fs reads, and must be shared by the driver and all executors.
Tasks write to a folder of their own beside the data; the commit moves what the tasks that count have written, an abort or a lost task leaves nothing that a reader sees. Overwriting moves the new
files in before it removes the old ones. A line is read in parts, and one beyond the limit is passed without being held. A reader's tasks get whole files.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# The version read and written, limits of a capture.
VERSION, LINE_BYTES, NODES = 1, 10 << 20, 5_000
NODE = pa.struct([("role", pa.string()), ("path", pa.string()), ("text", pa.string())])
CAPTURE = [("url", pa.string()), ("captured_at", pa.string()), ("title", pa.string()), ("nodes", pa.list_(NODE))]
FOUND = pa.schema([("file", pa.string()), ("line", pa.int64()), ("label", pa.string()), *CAPTURE, ("reason", pa.string()), ("raw", pa.string())])
NODES_DDL = "array<struct<role string, path string, text string>>"
FOUND_DDL = f"file string, line long, label string, url string, captured_at string, title string, nodes {NODES_DDL}, reason string, raw string"
PART, HEAD, PIECE = 1 << 16, 200, 1024


class Unusable(Exception):
    """With the reason."""


def fingerprint(nodes: list[dict]) -> str:
    """SHA-256 over the SHA-256 (lowercase hex) of every field of the nodes, in order of NODE."""
    return hashlib.sha256("".join(hashlib.sha256(x[f.name].encode()).hexdigest() for x in nodes for f in NODE).encode()).hexdigest()


def signed(nodes: Column) -> Column:
    """The fingerprint of a column of nodes."""
    return F.sha2(F.array_join(F.flatten(F.transform(nodes, lambda x: F.array(*(F.sha2(x[f.name].cast("binary"), 256) for f in NODE)))), ""), 256)


def line(url: Column, captured_at: Column, title: Column, nodes: Column, label: Column | None = None, sha256: Column | None = None, version: Column | int = VERSION) -> Column:
    """A capture as one line; where there is a label, as a baseline. Null nodes are none."""
    nodes = F.coalesce(nodes, F.array().cast(NODES_DDL))
    version = F.lit(version) if isinstance(version, int) else version
    own = F.struct(version.alias("version"), captured_at.alias("captured_at"), url.alias("url"), title.alias("title"), nodes.alias("nodes"), (signed(nodes) if sha256 is None else sha256).alias("sha256"))
    said = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    return said(own) if label is None else F.when(label.isNull(), said(own)).otherwise(said(F.struct(F.lit(VERSION).alias("baseline"), label.alias("label"), own.alias("capture"))))


def to_line(capture: dict, label: str | None = None) -> str:
    """The same of a capture in Python: url, captured_at, title, nodes."""
    nodes = capture["nodes"] or []
    own = {"version": VERSION, **{n: capture[n] for n, _ in CAPTURE}, "nodes": nodes, "sha256": fingerprint(nodes)}
    return json.dumps(own if label is None else {"baseline": VERSION, "label": label, "capture": own}, ensure_ascii=False)


def read_line(line: bytes) -> tuple[dict, str | None]:
    """The capture of a line and its label, or Unusable: not_json, not_a_capture, old_version, malformed, too_many_nodes or altered, asked in that order.

    Nothing is converted: a field that lacks, that nobody knows, or of another type makes a capture malformed; title alone may be null."""
    try:
        found = json.loads(line.decode())
    except (ValueError, RecursionError):
        raise Unusable("not_json") from None
    label = None
    if isinstance(found, dict) and "baseline" in found:
        label = found.get("label")
        if found["baseline"] != VERSION:
            raise Unusable("old_version")
        if found.keys() != {"baseline", "label", "capture"} or not isinstance(label, str):
            raise Unusable("malformed")
        found = found["capture"]
    if not isinstance(found, dict) or not {"version", "nodes"} <= found.keys():
        raise Unusable("not_a_capture")
    if found["version"] is True or found["version"] != VERSION:
        raise Unusable("old_version")
    nodes, text = found["nodes"], ("url", "captured_at", "sha256")
    known = {n for n, _ in CAPTURE} | {"version", "sha256"}
    if found.keys() != known or not all(isinstance(found[n], str) for n in text) or not isinstance(found["title"], str | None) or not isinstance(nodes, list):
        raise Unusable("malformed")
    if len(nodes) > NODES:
        raise Unusable("too_many_nodes")
    names = {f.name for f in NODE}
    if not all(isinstance(x, dict) and x.keys() == names and all(isinstance(v, str) for v in x.values()) for x in nodes):
        raise Unusable("malformed")
    try:
        json.dumps(found, ensure_ascii=False).encode()  # a lone surrogate is valid JSON and no text
    except UnicodeEncodeError:
        raise Unusable("malformed") from None
    if fingerprint(nodes) != found["sha256"]:
        raise Unusable("altered")
    return {n: found[n] for n, _ in CAPTURE}, label


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:") and not path.startswith("file://") else path)


def _files(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """Files of a folder that readers see."""
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


def _lines(stream, limit: int) -> Iterator[tuple[bytes, bool]]:
    """Lines of a stream and whether they are within the limit; of longer ones, their head."""
    held, over = b"", False
    while part := stream.read(PART):
        *whole, rest = part.split(b"\n")
        for x in whole:
            yield (held, False) if over or len(held) + len(x) > limit else (held + x, True)
            held, over = b"", False
        over = over or len(held) + len(rest) > limit
        held = (held + rest)[:HEAD * 4] if over else held + rest
    if held or over:
        yield held, not over


@dataclass
class Share(InputPartition):
    files: list[str]

    def __init__(self, files: list[str]):
        self.files = files


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.share, self.limit = int(options.get("sharebytes", 128 << 20)), int(options.get("linebytes", LINE_BYTES))

    def partitions(self) -> list[InputPartition]:
        """Files in shares of about so many bytes."""
        store, folder = _at(self.path)
        shares, size = [[]], 0
        for f in _files(store, folder):
            if shares[-1] and size + f.size > self.share:
                shares.append([])
                size = 0
            shares[-1].append(f.path)
            size += f.size
        return [Share(x) for x in shares]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        store, _ = _at(self.path)
        none = dict.fromkeys(FOUND.names)
        for file in partition.files:
            rows, size = [], 0
            with store.open_input_stream(file) as stream:
                for n, (line, whole) in enumerate(_lines(stream, self.limit)):
                    row = none | {"file": posixpath.basename(file), "line": n}
                    try:
                        if not whole:
                            raise Unusable("too_large")
                        found, row["label"] = read_line(line)
                        row |= found
                    except Unusable as why:
                        row |= {"label": None, "reason": str(why), "raw": line.decode(errors="replace")[:HEAD]}
                    rows.append(row)
                    size += len(line)
                    if len(rows) >= PIECE or size > LINE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=FOUND)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=FOUND)


@dataclass
class Wrote(WriterCommitMessage):
    file: str | None


class CaptureWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite, self.job = options["path"], names, overwrite, uuid.uuid4().hex
        store, folder = _at(self.path)
        store.create_dir(self._pending(folder), recursive=True)  # here, so that a task that outlives an abort finds no place to write to

    def _pending(self, folder: str) -> str:
        return f"{folder.rstrip('/')}/_pending-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        store, folder = _at(self.path)
        name, out = f"part-{self.job}-{uuid.uuid4().hex}.jsonl", None
        try:
            for batch in batches:
                some = batch.rename_columns(self.names)
                for row in (r for k in range(0, some.num_rows, 64) for r in some.slice(k, 64).to_pylist()):
                    if out is None:
                        out = store.open_output_stream(f"{self._pending(folder)}/{name}")
                    line = row["line"] if "line" in row else to_line(row, row.get("label"))
                    if line is None or "\n" in line:
                        raise ValueError("a capture is one line")
                    out.write(line.encode() + b"\n")
        finally:
            if out is not None:
                out.close()
        return Wrote(name if out is not None else None)

    def commit(self, messages: list[Wrote | None]) -> None:
        """Moves the files of the tasks that count, then removes the rest, and, when overwriting, what was there before."""
        store, folder = _at(self.path)
        before = _files(store, folder) if self.overwrite else []
        for m in messages:
            if m is not None and m.file:
                store.move(f"{self._pending(folder)}/{m.file}", f"{folder.rstrip('/')}/{m.file}")
        for f in before:
            store.delete_file(f.path)
        self.abort(messages)

    def abort(self, messages: list[Wrote | None]) -> None:
        store, folder = _at(self.path)
        if store.get_file_info(self._pending(folder)).type != fs.FileType.NotFound:
            store.delete_dir(self._pending(folder))


class Captures(DataSource):
    """Format `captures`. Rows to write have url, captured_at, title, nodes and, where they are baselines, label; or `line`, written as it is. Options: path, linebytes, sharebytes."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return FOUND_DDL

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        names = schema.fieldNames()
        lacks = [] if "line" in names else [n for n, _ in CAPTURE if n not in names]
        if lacks:
            raise ValueError(f"a capture needs {', '.join(lacks)}")
        return CaptureWriter(self.options, names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Captures)


def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures that can be used, and the rows (file, line, reason, raw: its first 200 characters) of those that can't."""
    good = found.where("reason is null").drop("reason", "raw")
    return good, found.where("reason is not null").select("file", "line", "reason", "raw")


def nodes_of(text: Column, role: str = "paragraph") -> Column:
    """Nodes of a text, one a line."""
    return F.transform(F.split(text, "\n"), lambda x, k: F.struct(F.lit(role).alias("role"), F.concat(F.lit("body/"), (k + 1).cast("string")).alias("path"), x.alias("text")))
