"""WARC archives (operator 11): one gzip member a record, read in sequence.

Writing: pages with equal payloads are found by digest; one of them is a response, the others are revisits that name it. Each task writes archives
of its own, `.warc.gz` files in which every record is a gzip member. Reading: an archive is a stream of blocks; members are inflated
piece by piece, a record's head gives the length of its content, and the digests that it states are held against what was read.
No record is held whole by the reader, no archive by anyone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ARCHIVE_BYTES = 1 << 30  # an archive is closed when it has so many bytes
BLOCK, FEED = 1 << 18, 1 << 14  # bytes read, or inflated to, at a time; bytes inflated at a time
HEAD_BYTES = 1 << 24  # a record's head, or that of its HTTP message, is shorter
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"  # pages carry no date of capture
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"

FIELDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("place", pa.int64()), ("error", pa.string())])
DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, place long, error string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def target(page_id: int, url: str | None) -> str:
    """The URL as a header's value: without signs that a URI can't have. Pages without one get the record's name."""
    return quote(url, safe="%!#$&'()*+,/:;=?@[]~") if url else f"urn:x-page:{page_id}"


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("WARC-Date", DATE), ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"), ("Content-Length", str(len(block)))])
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(VERSION + head.encode() + b"\r\n" + block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def page_record(page_id: int, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A page as a response, or as a revisit of the page `first`: it keeps the head of the HTTP message, which has the length of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", f"<urn:x-page:{page_id}>"), ("WARC-Target-URI", target(page_id, url)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32(hashlib.sha1(payload).digest())}")]
    if first is None:
        return record("response", fields, http + payload)
    return record("revisit", [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{first}>")], http)


class Members:
    """The gzip members of a stream, one after the other, inflated piece by piece."""

    def __init__(self, source) -> None:
        self.source, self.held, self.from_, self.at = source, b"", 0, 0  # at: the place in the stream of held[from_:]

    def _more(self) -> bool:
        block = self.source.read(BLOCK)
        self.held, self.from_ = self.held[self.from_ :] + block, 0
        return bool(block)

    def skip(self, n: int) -> None:
        self.from_, self.at = self.from_ + n, self.at + n

    def next_member(self) -> int | None:
        """The place where the next member begins, None at the end; what is no member is passed over."""
        while True:
            found = self.held.find(MAGIC, self.from_)
            if found >= 0:
                self.skip(found - self.from_)
                return self.at
            self.skip(max(0, len(self.held) - self.from_ - len(MAGIC) + 1))
            if not self._more():
                self.skip(len(self.held))
                return None

    def pieces(self) -> Iterator[bytes]:
        """The content of the member that begins here; ValueError where it is damaged or cut short."""
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if self.from_ == len(self.held) and not self._more():
                raise ValueError("cut short")
            given = memoryview(self.held)[self.from_ : self.from_ + FEED]
            try:
                piece = inflate.decompress(given, BLOCK)
            except zlib.error as e:
                raise ValueError("damaged member") from e
            self.skip(len(given) - len(inflate.unused_data if inflate.eof else inflate.unconsumed_tail))
            if piece:
                yield piece


def _head(raw: bytes) -> dict[str, str]:
    """Header lines by lower-case name."""
    pairs = (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k.strip()}


class Cut:
    """Pieces dealt into a head, up to an empty line, and what follows."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held = pieces, b""

    def head(self) -> bytes:
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if len(self.held) > HEAD_BYTES:
                raise ValueError("no end of the head")
            piece = next(self.pieces, None)
            if piece is None:
                raise ValueError("no end of the head")
            self.held += piece
        head, self.held = self.held[:end], self.held[end + 4 :]
        return head

    def body(self, n: int) -> Iterator[bytes]:
        """n bytes in pieces."""
        while n:
            if not self.held:
                self.held = next(self.pieces, b"")
                if not self.held:
                    raise ValueError("content shorter than stated")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece

    def ends(self) -> bool:
        """Whether just the two line ends after a record follow, to the end of its member."""
        for piece in self.pieces:
            self.held += piece
            if len(self.held) > 4:
                return False
        return self.held == b"\r\n\r\n"


def _number(name: str, text: str | None) -> int:
    if not text or not re.fullmatch(r"[0-9]+", text):
        raise ValueError(f"no {name}")
    return int(text)


def _page(name: str | None) -> int:
    found = re.fullmatch(r"<urn:x-page:(-?[0-9]+)>", name or "")
    if not found:
        raise ValueError("record of no page")
    return int(found[1])


def read_record(pieces: Iterator[bytes]) -> dict | None:
    """The columns of a response or revisit, None for other kinds of records. ValueError where it breaks the format or a stated digest."""
    cut = Cut(pieces)
    head = cut.head()
    if not re.match(rb"WARC/1\.[01]\r\n", head + b"\r\n"):
        raise ValueError("no record")
    own = _head(head)
    block, payload = hashlib.sha1(), hashlib.sha1()
    size = _number("content length", own.get("content-length"))
    kind = own.get("warc-type")
    http, had, raw = None, 0, b""
    for piece in cut.body(size):
        block.update(piece)
        if kind not in ("response", "revisit"):
            continue
        if http is None:
            raw += piece
            end = raw.find(b"\r\n\r\n")
            if end < 0 and len(raw) > HEAD_BYTES:
                raise ValueError("no end of the head")
            if end < 0:
                continue
            http, piece, raw = _head(raw[:end]), raw[end + 4 :], b""
        had += len(piece)
        payload.update(piece)
    if not cut.ends():
        raise ValueError("no end of the record")
    stated = own.get("warc-block-digest")
    if stated and stated != f"sha1:{base32(block.digest())}":
        raise ValueError("block digest differs")
    if kind not in ("response", "revisit"):
        return None
    if http is None:
        raise ValueError("no HTTP message")
    row = {"page_id": _page(own.get("warc-record-id")), "record_type": kind, "url": own.get("warc-target-uri"), "refers_to": None}
    digest, length = (own.get("warc-payload-digest") or "").removeprefix("sha1:"), _number("payload length", http.get("content-length"))
    if kind == "response":
        if had != length:
            raise ValueError("payload shorter or longer than stated")
        if digest and digest != base32(payload.digest()):
            raise ValueError("payload digest differs")
        digest = base32(payload.digest())
    else:
        if not digest:
            raise ValueError("revisit without a digest")
        row["refers_to"] = _page(own.get("warc-refers-to"))
    return row | {"payload_bytes": length, "payload_digest": digest}


def read_archive(source) -> Iterator[tuple[int, dict | None, str | None]]:
    """(place, columns, error) of each record in turn. After damage the reader goes on at what next looks like a member."""
    members, sound = Members(source), True
    while True:
        before = members.at
        place = members.next_member()
        if members.at != before and sound:
            yield before, None, "no member"
        if place is None:
            return
        pieces, sound = members.pieces(), True
        try:
            row = read_record(pieces)
        except ValueError as e:
            fault = str(e)
            try:  # to the end of the member, where it has one
                for _ in pieces:
                    pass
            except ValueError as damage:
                fault = str(damage)
            sound = fault not in ("damaged member", "cut short")
            if members.at == place:
                members.skip(1)
            yield place, None, fault
        else:
            if row is not None:
                yield place, row, None


def with_first(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the largest page_id of equal payloads, null where the page has it itself, and for payloads of fewer than
    `least` bytes. Only digests that several rows have are written down and joined; Spark sends them to all tasks only if their files are small, and splits
    a hot digest's rows otherwise."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).where("page_id is not null")
    keyed = rows.withColumn("digest", F.unhex(F.sha1("html")))
    shared = keyed.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.min("page_id").alias("other")).where("first <> other").select("digest", "first")
    shared = common.written(shared, common.shared_folder(pages.sparkSession))
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to")
    return keyed.join(shared, "digest", "left").select("page_id", "url", "html", refers)


def write_archives(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of (page_id, url, html) whose page_id isn't null; gives (archive string, records long, bytes long).

    A null html is the empty payload. Rows that repeat the largest page_id of their payload are responses all. A task writes
    under names of its own and renames an archive when it is whole, so a task that runs twice leaves the same files. folder: a URI that every executor reaches.
    """
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        part, k = TaskContext.get().partitionId(), 0
        sink = None
        for batch in common.slices(batches):
            for page_id, url, html, first in zip(*(batch.column(i) for i in range(4)), strict=True):
                if sink is None:
                    store.create_dir(root, recursive=True)
                    name, own = f"pages-{part:06d}-{k:04d}.warc.gz", f"{root}/.{part:06d}-{uuid.uuid4().hex}"
                    sink, records, size = store.open_output_stream(own, compression=None), 0, 0
                    sink.write(info := record("warcinfo", [("WARC-Record-ID", f"<urn:x-archive:{name}>"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    size += len(info)
                raw = page_record(page_id.as_py(), url.as_py(), html.as_py().encode(), first.as_py())
                sink.write(raw)
                records, size = records + 1, size + len(raw)
                if size >= archive_bytes:
                    sink.close()
                    store.move(own, f"{root}/{name}")
                    yield pa.RecordBatch.from_pydict({"archive": [name], "records": [records], "bytes": [size]}, schema=schema)
                    sink, k = None, k + 1
        if sink is not None:
            sink.close()
            store.move(own, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [records], "bytes": [size]}, schema=schema)

    return with_first(pages, least).mapInArrow(write, "archive string, records long, bytes long")


def read_archives(spark: SparkSession, folder: str, archives: list[str]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, archive, place, error: a row for each response or revisit, a task for each archive.

    What can't be read gives a row with its error and place in the archive, the other columns null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[dict] = []
                with store.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for place, row, error in read_archive(source):
                        rows.append((row or {}) | {"archive": name, "place": place, "error": error})
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=FIELDS)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=FIELDS)

    listed = spark.createDataFrame([(x,) for x in archives] or [("",)], "archive string").where("archive <> ''")
    return listed.repartition(max(1, len(archives))).mapInArrow(read, DDL)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, archive, place, error of all `pages`, read from the archives. A row for each
    archive, not page, is seen by the driver."""
    folder = f"{common.shared_folder(spark)}/archives"
    done = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder).select("archive").collect()
    return read_archives(spark, folder, sorted(r.archive for r in done)).drop("url", "archive", "place", "error")


#: The base-32 digest: five hexadecimal digits are four signs.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
d AS (SELECT *, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
