"""Packing (operator 3): shortest-pack-first over the histogram of lengths, patterns joined to documents by rank."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

SEQUENCE, END = 1024, 0


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in order of placing) and how often each is used.

    Lengths go longest first. Those of one length join the shortest packs, which have the most room; a pattern of
    which only a part is used is split by its count. Each step ends a length or a pattern, so steps and
    patterns depend on the limit, not on how many documents there are.
    """
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    done: list[tuple[tuple[int, ...], int]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in range(limit - 1, length - 1, -1):
            while left and open_packs[room]:
                pattern, n = open_packs[room].pop()
                used = min(left, n)
                if n > used:
                    open_packs[room].append((pattern, n - used))
                _keep(open_packs, done, pattern + (length,), used, room - length)
                left -= used
            if not left:
                break
        if left:
            _fresh(open_packs, done, length, left, limit)
    return done + [x for packs in open_packs.values() for x in packs]


def _keep(open_packs, done, pattern: tuple[int, ...], n: int, room: int) -> None:
    (open_packs[room] if room else done).append((pattern, n))


def _fresh(open_packs, done, length: int, left: int, limit: int) -> None:
    """New packs, each filled with as many of this length as fit."""
    many = limit // length
    if left >= many:
        _keep(open_packs, done, (length,) * many, left // many, limit - many * length)
    if left % many:
        _keep(open_packs, done, (length,) * (left % many), 1, limit - left % many * length)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, ranges of ranks: first rank (ascending), first sequence of the pattern, offset in it."""
    nexts: Counter[int] = Counter()
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            out[length].append((nexts[length], sequence, offset))
            nexts[length] += n
            offset += length
        sequence += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in out.items()}


def pieces(docs: DataFrame, path: str, limit: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and END, cut into full sequences and a rest."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.byte_level_coder(path)
        for batch in common.slices(batches, 4000):
            out = {n: [] for n in schema.names}
            for i, ids in tokens.coded(coder, batch):
                ids += END.to_bytes(4, "little")
                for at in range(0, len(ids), 4 * limit):
                    cut = ids[at : at + 4 * limit]
                    for name, value in zip(out, (i, at // 4, len(cut) // 4, zlib.crc32(cut), len(ids) // 4), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)
        del coder
        common.freed()

    return common.texts(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(cut: DataFrame, limit: int = SEQUENCE) -> DataFrame:
    """The pieces with sequence_id and offset. cut: pieces(), written down (it is read twice).

    Rank of a piece among those of its length: its place in one of many buckets of its documents' ids, after the
    pieces of the buckets before. So a length that most pieces have is ranked by many tasks. Only the histogram, a row for each
    length, goes to the driver, and only its patterns come back. Ties and repeated rows get ranks of their own.
    """
    spark = cut.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    table = slots(shortest_pack_first(histogram, limit))
    held = spark.sparkContext.broadcast(table)
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start")) - 1
    ranked = dealt.withColumn("rank", rank.cast("long")).join(F.broadcast(before) if len(histogram) * buckets <= 100_000 else before, ["length", "bucket"])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = pa.schema([(n, pa.int64()) for n in [*names, "sequence_id", "offset"]])

    def place(batch: pa.RecordBatch) -> dict:
        out = {n: batch.column(n).to_numpy() for n in names}
        rank, length = batch.column("rank").to_numpy(), out["length"]
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for k in np.unique(length):
            own = length == k
            first, start, at = held.value[k]
            j = np.searchsorted(first, rank[own], "right") - 1
            sequence[own], offset[own] = start[j] + rank[own] - first[j], at[j]
        return out | {"sequence_id": sequence, "offset": offset}

    return common.map_batches(ranked.select(*names, (F.col("rank") + F.col("base")).alias("rank")), place, schema, ", ".join(f"{n} long" for n in schema.names), most=1 << 20)


def pack_documents(docs: DataFrame, path: str | None = None, limit: int = SEQUENCE) -> DataFrame:
    """Reads doc_id, text (null: empty, one id); gives a row for each piece. path: a byte-level BPE of the tokenizers library."""
    cut = pieces(docs, path or tokens.vocabulary("byte_bpe_50k.json"), limit)
    return pack(common.written(cut, common.shared_folder(docs.sparkSession)), limit)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack_documents(common.documents(spark, sf_dir))
