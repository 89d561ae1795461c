"""The corpus pipeline: quality, lines, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; the next one reads it as its docs. All but the last return the
columns of documents (doc_id, text, lang, source, n_chars), with n_chars that of the new text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common, kneser_ney, line_dedup, packing, pii, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE, SIMILARITY = 5, 0.8  # words of a near-duplicate shingle; least part of their different shingles that near duplicates share


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose perplexity is above their language's limit. Empty texts stay."""
    return kneser_ney.judged(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet")).where("keep").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold stay in the first of them only."""
    return line_dedup.dedup_rows(docs.select(*COLUMNS), keep_first=True).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest doc_id.

    Rows that repeat a doc_id and text are one document, of which the row least by lang, source and n_chars stays. Rows that share a doc_id but not a
    text are documents of their own, with an id made of both.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *COLUMNS[1:])
    repeated = common.repeated_ids(rows)
    if repeated is None:
        rows = rows.select("*", F.col("doc_id").alias("node"), F.lit(False).alias("again"))
    else:
        made = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
        rows = rows.join(repeated, "doc_id", "left").select(*COLUMNS, F.when(F.col("differ"), made).otherwise(F.col("doc_id")).alias("node"), F.col("differ").isNotNull().alias("again"))
    groups = simhash.similar_groups(rows.select(F.col("node").alias("doc_id"), "text"), words=SHINGLE, similarity=SIMILARITY)
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("node")).distinct()
    kept = rows.join(first, "node", "left_semi")
    if repeated is None:
        return kept.select(*COLUMNS)
    one = kept.where("again").groupBy("node").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("x")).select("x.*")
    return kept.where("not again").select(*COLUMNS).union(one.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With placeholders where personal data were. A null text stays null."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())])
    rows = lambda b: {n: b.column(n) for n in schema.names} | {"text": [None if t is None else pii.masked(t) for t in b.column("text").to_pylist()]}
    out = common.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source"), rows, schema, "doc_id long, text string, lang string, source string")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near duplicates", near_duplicates), ("personal data", personal_data), ("packing", pack)]

#: The first stage's model and the last one's tokens are beyond SQL. Tests hold the model, the lines, the groups, the base spans and the pieces against
#: brute-force versions, and the stages in a row against these.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it wrote on their way is removed as soon as it is read."""
    docs, others = common.documents(spark, sf_dir), common.folders()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs, folder := common.shared_folder(spark))
            common.drop_folders(spark, but=[*others, folder])
    return docs
