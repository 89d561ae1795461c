"""What the operators share: input tables, the shared folder, Arrow batches, connected components.

Conventions of every operator of this subpackage: only the columns named in its docstring are read, so other
columns, whatever their names, do no harm; rows whose id is null cannot be named in a result and are left out; a null
text counts as the empty text; an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string), null texts as empty, rows without an id left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")


_folders: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one the cluster names in spark.checkpoint.dir. Where that is unset a session on one machine, as in tests, gets
    a local one; on a cluster there is no folder that all executors reach, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.palimpsest.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
        spark.conf.set("spark.palimpsest.scratch", base)
    _folders.append(f"{base.rstrip('/')}/palimpsest-{uuid.uuid4().hex}")
    return _folders[-1]


def folders() -> list[str]:
    """The folders made so far."""
    return [*_folders]


def drop_folders(spark: SparkSession, but: list[str]) -> None:
    """Drops the folders made so far, but those. What reads them must have run to its end."""
    for path in [p for p in _folders if p not in but]:
        drop_folder(spark, path)
        _folders.remove(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, folder: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends there, and lost executors cost nothing."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def repeated_ids(docs: DataFrame) -> DataFrame | None:
    """(doc_id, differ boolean), written down: the ids that several rows of texts() have, and whether their texts differ; None without any."""
    rows = texts(docs)
    folder = shared_folder(docs.sparkSession)
    repeated = written(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), f"{folder}/ids")
    if repeated.isEmpty():
        drop_folder(docs.sparkSession, folder)
        return None
    h = F.xxhash64("text")
    own = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg((F.min(h) != F.max(h)).alias("differ"))
    return written(own, f"{folder}/differ")


def told_apart(docs: DataFrame) -> DataFrame:
    """(doc_id, tie long, text) of texts(): tie is 0, but where rows of one doc_id differ in text it is a hash of the text."""
    rows, repeated = texts(docs), repeated_ids(docs)
    if repeated is None:
        return rows.select("doc_id", F.lit(0).cast("long").alias("tie"), "text")
    tie = F.when(F.col("differ"), F.xxhash64("text")).otherwise(0)
    return rows.join(repeated, "doc_id", "left").select("doc_id", tie.alias("tie"), "text")


SENT_IDS = 8 << 20  # ids that go to every task, eight bytes each; more are joined


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of (doc_id long, ...) whose doc_id is among ids (doc_id long, none twice, written down)."""
    if ids.count() > SENT_IDS:
        return rows.join(ids, "doc_id", "left_semi")
    schema = pa.schema([("ids", pa.binary())])
    packed = ids.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"ids": [b.column(0).to_numpy().tobytes()]}, schema=schema) for b in batches), "ids binary").collect()
    held = ids.sparkSession.sparkContext.broadcast(np.sort(np.frombuffer(b"".join(bytes(r[0]) for r in packed), np.int64)).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(held.value, np.int64)
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            yield b.filter(pa.array(known[at] == own if len(known) else np.zeros(len(own), bool)))

    return rows.mapInArrow(run, rows.schema)


def freed() -> None:
    """Gives memory that this worker has freed back to the machine. Workers are kept from task to task, and what one stage took would stay with the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the usual library
        pass


def slices(batches: Iterator[pa.RecordBatch], most: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that a worker holds Python objects of few texts at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, most):
            yield batch.slice(k, most)
        del batch
        freed()


def map_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: pa.Schema, ddl: str, most: int = 1000) -> DataFrame:
    """rows: a dict of equally long columns for each part of an Arrow batch of at most so many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most):
            yield pa.RecordBatch.from_pydict(rows(batch), schema=schema)

    return df.mapInArrow(run, ddl)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a long, b long): (id, component_id = the smallest id reachable), linked ids only.

    Alternating large-star and small-star steps. Each step takes a minimum per vertex, which is combined before its
    shuffle, and one join on the vertex, whose hot keys adaptive execution splits. Rows never exceed twice the edges.
    Every round is written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    root = shared_folder(spark)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(edges, f"{root}/0")
    sign = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003), F.sum(F.xxhash64("b", "a") % 1000033)).alias("s")
    before, k = None, 0
    while (found := tuple(now.agg(sign).first()[0])) != before:
        before, k = found, k + 1
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, f"{root}/{k}l")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        now = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{root}/{k}s")
        drop_folder(spark, f"{root}/{k}l")
        drop_folder(spark, f"{root}/{k - 1}s" if k > 1 else f"{root}/0")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(now.select("b", "b").distinct())
