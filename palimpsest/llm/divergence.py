"""Source divergence audit (operator 13): two-dimensional tiles of groups by groups.

A group is the documents of one language and source. Terms are counted where the texts are read and summed by joins on keys. Each language's vocabulary is dealt into
chunks and its groups into blocks, both by hash and of bounded size. A group's counts in a chunk are packed into one row, which is sent to each tile that its block
is part of; a task goes through successive chunks of its tile and adds to the tile's matrix of differences. Tiles are also split by spans of chunks, whose matrices are summed, so that
a language with few sources has many tasks, and none holds more than a chunk of two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

LEAST_DOCS, TOP = 30, 50
ONE, PRIOR = 1_000_000_000, 5  # p = 1 + floor(ONE * (count + PRIOR) / (N + PRIOR * V))
CHUNK, SPAN, GROUPS = 1024, 4, 32  # terms of a chunk, chunks of a task, groups of a block, all about so many
BATCH_BYTES = 16 << 20  # texts counted at a time, one text at least

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

#: By byte: 0 for what separates terms, else the byte, A-Z as a-z. Bytes of signs beyond ASCII are parts of terms.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0
FOLD[0x41:0x5B] += 32


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in turn, and the text that each is of."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    folded = FOLD[raw]
    inside = folded != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    border = ends[:-1][np.diff(ends) > 0]
    begins[border] = inside[border]
    at = np.flatnonzero(begins)
    kept = folded[inside]
    offsets = np.r_[np.cumsum(inside)[at] - 1, len(kept)].astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept)))
    return words, np.searchsorted(ends, at, side="right") - 1


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of BATCH_BYTES of text."""
    sizes = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
    at, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > BATCH_BYTES:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += size
    if batch.num_rows > at:
        yield batch.slice(at)


def group_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term. Each group also has a row whose term is null. Rows may repeat; their numbers add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                words, doc = terms(batch.column(0))
                langs, sources = (batch.column(k).dictionary_encode() for k in (1, 2))
                pair = langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
                groups, of = np.unique(pair, return_inverse=True)
                coded = words.dictionary_encode()
                width = max(1, len(coded.dictionary))
                code = coded.indices.to_numpy().astype(np.int64)
                held, n = np.unique(doc * width + code, return_counts=True)  # a term of a document
                key = of[held // width] * width + held % width
                order = np.argsort(key, kind="stable")
                key, starts = np.unique(key[order], return_index=True)
                total = np.add.reduceat(n[order], starts) if len(starts) else np.zeros(0, np.int64)
                number = np.diff(np.r_[starts, len(held)])
                group, term = key // width, pa.array(key % width)
                lang = langs.dictionary.take(pa.array(groups // max(1, len(sources.dictionary))))
                source = sources.dictionary.take(pa.array(groups % max(1, len(sources.dictionary))))
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(group)), source.take(pa.array(group)), coded.dictionary.take(term), pa.array(total), pa.array(number)], schema=COUNTS)
                yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(lang), pa.string()), pa.array([0] * len(lang), pa.int64()), pa.array([0] * len(lang), pa.int64())], schema=COUNTS)

    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return own.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(ONE * (count + PRIOR) / total) in whole numbers: three digits at a time, so that nothing passes 64 bits below 9e15 terms."""
    div = lambda a: F.call_function("div", a, total)
    value, left = div(count + PRIOR), (count + PRIOR) % total
    for _ in range(3):
        value, left = value * 1000 + div(left * 1000), (left * 1000) % total
    return value + 1


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same of arrays."""
    value, left = np.divmod(counts + PRIOR, totals)
    for _ in range(3):
        step, left = np.divmod(left * 1000, totals)
        value = value * 1000 + step
    return value + 1


class Tables:
    """What the audit is made from, each written to the shared folder.

    counts: lang, source, term, n, docs, once each; term is null in the row of a group itself.
    vocabulary: lang, term, total, chunk, slot (from 0 in its chunk) of kept terms.
    languages: lang, v (its kept terms), lang_n (their occurrences). chunks: lang, chunk, size.
    kept: lang, source, term, n, total, chunk, slot.
    groups: lang, source, own_n, v, lang_n, blocks, block; all groups, also without terms.
    """

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS, chunk: int = CHUNK, groups: int = GROUPS) -> None:
        folder = common.shared_folder(docs.sparkSession)
        keep = lambda df, name: common.written(df, f"{folder}/{name}")
        summed = group_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        self.counts = keep(summed, "counts")
        common_terms = self.counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
        common_terms = keep(common_terms.select("lang", "term", "total"), "terms")
        self.languages = keep(common_terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n")), "languages")
        dealt = common_terms.join(self.languages, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / chunk)).cast("int"))
        slot = (F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).alias("slot")
        self.vocabulary = keep(dealt.select("lang", "term", "total", "chunk", slot), "vocabulary")
        self.chunks = keep(self.vocabulary.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("size")), "chunks")
        self.kept = keep(self.counts.select("lang", "source", "term", "n").join(self.vocabulary, ["lang", "term"]), "kept")
        own = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
        every = self.counts.where("term is null").select("lang", "source")
        number = every.groupBy("lang").agg(F.ceil(F.count("*") / groups).cast("int").alias("blocks"))
        zero = lambda *names: [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names]
        all_groups = every.join(own, ["lang", "source"], "left").join(self.languages, "lang", "left").join(keep(number, "number"), "lang")
        block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
        self.groups = keep(all_groups.select("lang", "source", *zero("own_n", "v", "lang_n"), "blocks", block), "groups")


def tiles(t: Tables, span: int = SPAN) -> DataFrame:
    """(lang, lo, hi, span, chunk, block, source, total, size, packed): each group's counts in each chunk, once for each tile of its block."""
    packed = t.kept.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("slot", "n")).alias("packed"))
    dense = t.groups.join(t.chunks, "lang", "left").select("lang", "source", "blocks", "block", (F.col("own_n") + PRIOR * F.col("v")).alias("total"), F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("size", F.lit(0)).alias("size"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = dense.join(packed, ["lang", "source", "chunk"], "left").select("*", other)
    return rows.select("lang", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.floor(F.col("chunk") / span).cast("int").alias("span"), "chunk", "block", "source", "total", "size", "packed")


def differences(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each span of a tile, the sums over its chunks, in both directions."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def vectors(held: list[dict], size: int) -> np.ndarray:
        counts = np.zeros((len(held), size), np.int64)
        for k, r in enumerate(held):
            counts[k, r["slots"]] = r["counts"]
        return shares(counts, np.array([[r["total"]] for r in held], np.int64)) if size else counts

    def added(matrix: np.ndarray | None, key: tuple, held: list[dict]) -> tuple[np.ndarray, list[str], list[str]]:
        """The tile's matrix with a chunk more, and the sources of its sides; held: the chunk's rows in the order of sources."""
        sides = [[r for r in held if r["block"] == b] for b in key[1:3]]
        left, right = (vectors(side, side[0]["size"] if side else 0) for side in sides)
        if matrix is None:
            matrix = np.zeros((len(left), len(right)), np.int64)
        if len(right):
            for k in range(len(left)):
                matrix[k] += np.abs(left[k] - right).sum(1)
        return matrix, [r["source"] for r in sides[0]], [r["source"] for r in sides[1]]

    def result(key: tuple, matrix: np.ndarray, one: list[str], two: list[str]) -> pa.RecordBatch:
        i, j = (x.ravel() for x in np.indices(matrix.shape))
        own = np.array([a != b for a in one for b in two], bool)
        i, j, value = i[own], j[own], matrix.ravel()[own]
        if key[1] != key[2]:  # a tile of two blocks stands for its mirror image too
            i, j, value = np.r_[i, j + len(one)], np.r_[j + len(one), i], np.r_[value, value]
            one = two = pa.array([*one, *two], pa.string())
        else:
            one = two = pa.array(one, pa.string())
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(i), pa.string()), one.take(pa.array(i)), two.take(pa.array(j)), pa.array(value)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chunk, held, matrix, sides = None, None, [], None, ([], [])
        for batch in batches:
            slots, counts = (batch.column("packed").flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(batch.column("packed")), 0).to_numpy())]
            facts = batch.drop_columns(["packed"]).to_pylist()
            for k, r in enumerate(facts):
                now = r["lang"], r["lo"], r["hi"], r["span"]
                if held and (now != key or r["chunk"] != chunk):
                    matrix, *sides = added(matrix, key, held)
                    held = []
                if key is not None and now != key:
                    yield result(key, matrix, *sides)
                    matrix = None
                key, chunk = now, r["chunk"]
                a, b = ends[k], ends[k + 1]
                held.append(r | {"slots": slots[a:b].copy(), "counts": counts[a:b].copy()})
        if held:
            matrix, *sides = added(matrix, key, held)
            yield result(key, matrix, *sides)

    dealt = rows.repartition("lang", "lo", "hi", "span").sortWithinPartitions("lang", "lo", "hi", "span", "chunk", "source")
    return dealt.mapInArrow(run, "lang string, source string, item string, value long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, chunk: int = CHUNK, span: int = SPAN, groups: int = GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part "pair": item is another source of the language, value the sum of |p - q| over the language's kept terms. Part "term": item is a term that the source uses more than
    the language does, value p - q, for the `top` largest. Reads text, lang, source; nulls are empty strings; each row is a document, whatever its other columns and
    whether rows repeat. A language with one source has no pairs; one without kept terms has pairs of value 0; equal values rank by item. No rows, no result.
    """
    t = Tables(docs, least_docs, chunk, groups)
    pair = differences(tiles(t, span)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    facts = t.groups.select("lang", "source", (F.col("own_n") + PRIOR * F.col("v")).alias("total_own"), (F.col("lang_n") + PRIOR * F.col("v")).alias("total_lang"))
    term = t.kept.join(facts, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (share(F.col("n"), F.col("total_own")) - share(F.col("total"), F.col("total_lang"))).alias("value"))
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(own).alias("rank"))
    return ranked(pair, "pair").union(ranked(term.where("value > 0"), "term").where(F.col("rank") <= top))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank over all `documents`."""
    return audit(common.documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, term, total, coalesce(n, 0)::HUGEINT AS n FROM g JOIN kept USING (lang)
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) USING (lang, source, term)),
p AS (SELECT *, 1 + 1000000000 * (n + 5) // (sum(n) OVER s + 5 * count(*) OVER s)::HUGEINT AS p,
  1 + 1000000000 * (total + 5) // (sum(total) OVER s + 5 * count(*) OVER s)::HUGEINT AS q FROM c WINDOW s AS (PARTITION BY lang, source)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(x.p - y.p)) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  WHERE x.term IS NULL OR y.term IS NOT NULL GROUP BY ALL),
every AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
