"""Where a plan is cut: what several parts of a query read is computed once and kept in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: dict[int, str] = {}


def folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir; a session on one machine without it gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.palimpsest.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
        spark.conf.set("spark.palimpsest.scratch", base)
    return f"{base.rstrip('/')}/palimpsest-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written as columns to the shared folder and read again; readers take only the columns that they need."""
    path = folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    return out


def drop(df: DataFrame) -> None:
    """Removes what written() wrote for these rows. What reads them must have run to its end."""
    path = _paths.pop(id(df), None)
    if path is not None:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


cut = written
