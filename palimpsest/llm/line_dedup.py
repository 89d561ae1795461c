"""Line dedup (operator 1): two Bloom filters find suspected repeats, only those shuffle, and are confirmed exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, repeat_filter

PLACES = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("line", pa.int32())])
DEALT = pa.schema([("range", pa.int32()), ("h", pa.int64()), ("sure", pa.bool_()), *PLACES])
PLACES_DDL, DEALT_DDL = "digest binary, doc_id long, line int", "range int, h long, sure boolean, digest binary, doc_id long, line int"


def line_key(line: bytes) -> bytes:
    """ASCII white space off both ends, A-Z lower-cased."""
    return line.strip().lower()


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def counts(key: bytes, min_chars: int) -> bool:
    """Whether a key has so many code points."""
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def _raw(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8."""
    return column.cast(pa.binary()).to_pylist()


def _first_lines(text: bytes, min_chars: int) -> dict[bytes, int]:
    """Number of the first line of each key of a text."""
    lines = [*map(line_key, text.split(b"\n"))]
    first = dict(zip(reversed(lines), range(len(lines) - 1, -1, -1), strict=True))
    return {k: n for k, n in first.items() if counts(k, min_chars)}


def repeated_lines(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(digest, n_docs, doc_id, line) of each line key found in min_docs documents at least; doc_id, line: its first occurrence."""
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(k) for t in _raw(batch.column(0)) for k in {*map(line_key, t.split(b"\n"))} if counts(k, min_chars)], np.uint64)

    def keyed(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        keys, at, n = [], [], []
        for i, t in enumerate(_raw(batch.column(1))):
            first = _first_lines(t, min_chars)
            keys += first
            n += first.values()
            at += [i] * len(first)
        return keys, np.array([*map(xxhash.xxh3_64_intdigest, keys)], np.uint64), batch.column(0).to_numpy()[at] if at else np.zeros(0, np.int64), np.array(n, np.int32)

    if min_docs < 2:  # every line repeats
        found = common.map_batches(docs, lambda b: _places(*keyed(b), slice(None)), PLACES, PLACES_DDL)
    else:
        twice = repeat_filter.twice_seen(docs.select("text"), hashes, lines, listed=True)
        if twice.held is not None:
            test = twice.tester()

            def suspects(batch: pa.RecordBatch) -> dict:
                keys, h, ids, n = keyed(batch)
                return _places(keys, h, ids, n, np.flatnonzero(test(h)))

            found = common.map_batches(docs, suspects, PLACES, PLACES_DDL)
        else:
            ranges = twice.ranges

            def all_lines(batch: pa.RecordBatch) -> dict:
                keys, h, ids, n = keyed(batch)
                _, back, times = np.unique(h, return_inverse=True, return_counts=True)
                sure = times[back] > 1
                to = np.where(sure, np.arange(len(h)) % ranges, repeat_filter.range_of(h, ranges)).astype(np.int32)
                return {"range": to, "h": h.view(np.int64), "sure": sure, **_places(keys, h, ids, n, slice(None))}

            found = twice.suspected(common.map_batches(docs, all_lines, DEALT, DEALT_DDL))
    counted = found.groupBy("digest").agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "line")).alias("first"))
    return counted.where(F.col("n_docs") >= min_docs).select("digest", "n_docs", "first.doc_id", "first.line")


def _places(keys: list[bytes], h: np.ndarray, ids: np.ndarray, n: np.ndarray, own) -> dict:
    return {"digest": [digest(keys[k]) for k in range(len(keys))[own]] if isinstance(own, slice) else [digest(keys[k]) for k in own], "doc_id": ids[own], "line": n[own]}


def dedup_rows(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, broadcast_rows: int = 500_000) -> DataFrame:
    """docs with n_lines, n_dropped and a text without lines whose key is in min_docs documents at least.

    Reads doc_id, text; other columns stay, n_chars, where there is one, as the new text's; n_lines and n_dropped are replaced. keep_first: lines stay in
    their first occurrence, that of the smallest (doc_id, line). A key is the line stripped of ASCII white space and with A-Z
    lower-cased; empty keys (below min_chars code points) always stay. Null or empty text: one empty line. Rows without
    doc_id are left out; repeated rows count as documents of their own. Up to broadcast_rows repeated lines (24
    bytes each) go to every task; more are joined by digest and document instead, with the same result.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce("text", F.lit(""))}).drop("n_lines", "n_dropped")
    lean = docs.select("doc_id", "text")
    root = common.shared_folder(spark)
    repeated = common.written(repeated_lines(lean, min_docs, min_chars), root)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields]).add("n_lines", "long").add("n_dropped", "long")
    few = repeated.count() <= broadcast_rows
    if few:
        held = spark.sparkContext.broadcast({bytes(d): (i, n) for d, _, i, n in repeated.collect()})
        common.drop_folder(spark, root)
    else:
        drop = common.map_batches(lean, _keyed(min_chars), PLACES, PLACES_DDL).distinct()
        drop = drop.join(repeated.select("digest", F.col("doc_id").alias("first_doc"), F.col("line").alias("first_line")), "digest")
        if keep_first:
            drop = drop.where("doc_id <> first_doc or line <> first_line")
        gone = next(x for x in (f"drop{k}" for k in range(len(names) + 1)) if x not in names)
        docs = docs.join(drop.groupBy("doc_id").agg(F.collect_list("line").alias(gone)), "doc_id", "left").select(*names, gone)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = held.value if few else {}, {n: k for k, n in enumerate(names)}
        for batch in common.slices(batches):
            texts, n_lines, n_dropped = [], [], []
            gone = [None] * batch.num_rows if few else batch.column(len(names)).to_pylist()
            for i, t, drop in zip(batch.column(at["doc_id"]).to_pylist(), _raw(batch.column(at["text"])), gone, strict=True):
                lines = t.split(b"\n")
                if few:
                    kept = [x for n, x in enumerate(lines) if not _goes(where, line_key(x), (i, n), min_chars, keep_first)]
                else:
                    drop = set(drop or ())
                    kept = [x for n, x in enumerate(lines) if n not in drop]
                texts.append(t if len(kept) == len(lines) else b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            text = pa.array(texts, pa.binary()).cast(pa.string())
            new = {"text": text} | ({"n_chars": pc.utf8_length(text).cast(pa.int64())} if "n_chars" in at else {})
            yield pa.RecordBatch.from_arrays([*(new.get(n, batch.column(k)) for n, k in at.items()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return docs.mapInArrow(cut, schema)


def _goes(where: dict, key: bytes, place: tuple, min_chars: int, keep_first: bool) -> bool:
    first = where.get(digest(key)) if counts(key, min_chars) else None
    return first is not None and not (keep_first and first == place)


def _keyed(min_chars: int):
    def every(batch: pa.RecordBatch) -> dict:
        rows = [(digest(k), i, n) for i, t in zip(batch.column(0).to_pylist(), _raw(batch.column(1)), strict=True) for n, x in enumerate(t.split(b"\n")) if counts(k := line_key(x), min_chars)]
        return {n: [r[c] for r in rows] for c, n in enumerate(PLACES.names)}

    return every


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of dedup_rows, with its options."""
    return dedup_rows(docs.select("doc_id", "text"), **options).select("doc_id", "n_lines", "n_dropped", F.col("text").alias("kept_text"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup_lines(common.documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, n, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL))),
gone AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(gone.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (gone.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN gone USING (key) GROUP BY doc_id
"""
