"""Embedding near-dedup (operator 5): subspace pigeonhole join.

Unit vectors with cosine >= c are at most sqrt(2 - 2c) apart. After a rotation, coordinates are split into blocks; a pair within
that distance is, in one block at least, within the block's share of the squared distance. Each block is joined by range: a grid
over its leading coordinates, with cells as wide as the block's radius, finds the pairs of neighbouring cells, which are then filtered
by their distance in the block and by bounds on the whole cosine. What the bounds leave open is verified exactly.

Vectors are shuffled as bytes, in tiles: each tile meets each other one once, and a task joins all blocks of two tiles. So what is shuffled is TILES copies of these bytes
for each vector, whatever the cells hold, up to TILES * TILE vectors; a task tells how many links its vectors have and what is linked to what, not the links one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COSINE, BLOCKS, LEADING, TILES, TILE = 0.9, 4, 2, 8, 1 << 19
SLACK = 1e-6  # what rounding of the rotation may add to a distance


def rotation(dims: int) -> np.ndarray:
    """The same orthogonal matrix everywhere."""
    return np.linalg.qr(np.random.default_rng(7).standard_normal((dims, dims)))[0]


def radii(dims: int, cosine: float, blocks: int) -> tuple[list[np.ndarray], list[float]]:
    """Blocks of coordinates, and each one's radius: its share of the squared distance is in proportion to its coordinates."""
    parts = np.array_split(np.arange(dims), min(blocks, dims))
    return parts, [float(np.sqrt((2 - 2 * cosine) * len(p) / dims)) + SLACK for p in parts]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of vectors that can link: no null or non-finite component, not zero."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return v.where("vec_id is not null").where(fine)


def coded(reps: DataFrame, tiles: int) -> DataFrame:
    """(dims, tile, rep, copies, scale, rest, code): the vectors of a part of the rows and a tile, packed end to end.

    code: the rotated unit vectors in bytes, rest: how far one is from what code and scale say, so bounds stay exact.
    """
    names = ("rep", "copies", "scale", "rest", "code")
    schema = pa.schema([("dims", pa.int32()), ("tile", pa.int32()), *((n, pa.binary()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, raw = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            sizes = np.diff(raw.offsets.to_numpy())
            flat, at = raw.flatten().to_numpy(), np.r_[0, np.cumsum(sizes)]
            for dims in np.unique(sizes):
                own = np.flatnonzero(sizes == dims)
                x = np.stack([flat[at[i] : at[i + 1]] for i in own])
                x /= np.abs(x).max(1, keepdims=True)
                y = x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation(dims)
                scale = (np.abs(y).max(1) / 127).astype(np.float32)
                code = np.clip(np.rint(y / scale[:, None]), -127, 127).astype(np.int8)
                rest = (np.linalg.norm(y - code * scale[:, None].astype(np.float64), axis=1) * (1 + 1e-6) + 1e-7).astype(np.float32)
                tile = batch.column(3).to_numpy()[own]
                for t in np.unique(tile):
                    k = np.flatnonzero(tile == t)
                    parts = (ids[own[k]].astype("<i8"), copies[own[k]].astype("<i8"), scale[k].astype("<f4"), rest[k].astype("<f4"), code[k])
                    yield pa.RecordBatch.from_pydict({"dims": [int(dims)], "tile": [int(t)]} | {n: [v.tobytes()] for n, v in zip(names, parts, strict=True)}, schema=schema)

    rows = reps.select("rep", "copies", F.col("embedding").cast("array<double>").alias("embedding"), F.pmod(F.xxhash64("rep"), F.lit(tiles)).cast("int").alias("tile"))
    return rows.mapInArrow(run, "dims int, tile int, rep binary, copies binary, scale binary, rest binary, code binary")


def near(x: np.ndarray, y: np.ndarray, width: float, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of rows of x and y that are at most about `radius` apart, none left out, in parts: rows of neighbouring cells of a grid of that width over the leading coordinates."""
    if not len(x) or not len(y):
        return
    grid = [np.floor(z[:, :LEADING] / width).astype(np.int64) for z in (x, y)]
    held = []
    for cell in grid:
        order = np.lexsort(cell.T)
        starts = np.r_[0, np.flatnonzero((np.diff(cell[order], axis=0) != 0).any(1)) + 1, len(order)]
        held.append({tuple(cell[order[a]].tolist()): order[a:b] for a, b in zip(starts, starts[1:], strict=False)})
    half = [(z.astype(np.float32) ** 2).sum(1, keepdims=True) / 2 for z in (x, y)]
    one = np.float32(1)
    x, y = np.hstack([x, -half[0], np.full_like(half[0], one)]).astype(np.float32), np.hstack([y, np.full_like(half[1], one), -half[1]]).astype(np.float32)
    least = np.float32(-(radius**2) / 2 - 1e-5)  # of x * y less half of both squares, which is half the squared distance below zero
    for cell, own in held[0].items():
        there = [held[1][c] for step in product((-1, 0, 1), repeat=len(cell)) if (c := tuple(a + b for a, b in zip(cell, step, strict=True))) in held[1]]
        others = np.concatenate(there) if there else own[:0]
        for b in range(0, len(others), 4096):
            part = others[b : b + 4096]
            z = y[part].T.copy()
            for a in range(0, len(own), 256):
                i, j = np.divmod(np.flatnonzero((x[own[a : a + 256]] @ z).ravel() >= least), len(part))
                if len(i):
                    yield own[a + i], part[j]


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Links i to j in label, which holds for each row one of its component, its own for the first of it."""
    while True:
        while not np.array_equal(up := label[label], label):
            label[:] = up
        p, q = label[i], label[j]
        apart = p != q
        if not apart.any():
            return
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))


def candidates(reps: DataFrame, cosine: float, blocks: int) -> DataFrame:
    """(a, b, n). Without n, a < b: a pair that may reach `cosine`, as its bounds leave open. With n: b is linked to a, or a itself, and n is how many vectors of another tile, or
    of its own, copies counted, are linked to a for certain."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def compare(key, t):
        dims, i, j = (k.as_py() for k in key)
        parts, radius = radii(dims, cosine, blocks)
        tile = t.column("tile").to_numpy()
        rows = np.r_[np.flatnonzero(tile == i), np.flatnonzero(tile != i)]
        read = lambda c, kind, at: np.frombuffer(b"".join(t.column(c)[int(k)].as_py() for k in at), kind)
        rep, copies, scale, rest = (read(c, kind, rows) for c, kind in (("rep", "<i8"), ("copies", "<i8"), ("scale", "<f4"), ("rest", "<f4")))
        code = read("code", np.int8, rows).reshape(-1, dims)
        first = len(read("rep", "<i8", np.flatnonzero(tile == i)))
        left, right = slice(0, first), slice(0 if i == j else first, len(rep))
        label, links, open_pairs = np.arange(len(rep)), np.zeros(len(rep), np.int64), []
        most = 2 * float(rest.max()) if len(rest) else 0.0
        for b, (part, r) in enumerate(zip(parts, radius, strict=True)):
            value = code[:, part] * scale[:, None]
            reach = float(np.sqrt((r + most) ** 2 + SLACK)) * (1 + 1e-6)
            for p, q in near(value[left], value[right], reach, reach):
                q = q + right.start
                if i == j:
                    p, q = p[rep[p] < rep[q]], q[rep[p] < rep[q]]
                for k in range(0, len(p), 1 << 16):
                    u, v = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
                    x, y = (code[w] * scale[w, None].astype(np.float64) for w in (u, v))
                    off = rest[u].astype(np.float64) + rest[v]
                    within = [((x[:, c] - y[:, c]) ** 2).sum(1) <= (radius[n] + off) ** 2 + SLACK for n, c in enumerate(parts[: b + 1])]
                    fresh = within[-1] & ~np.logical_or.reduce([*within[:-1], np.zeros(len(u), bool)])  # each pair in the first block that joins it
                    dot, off = (x * y).sum(1), off + rest[u].astype(np.float64) * rest[v]
                    sure, maybe = fresh & (dot - off >= cosine + SLACK), fresh & (dot - off < cosine + SLACK) & (dot + off >= cosine - SLACK)
                    open_pairs.append(np.stack([rep[u[maybe]], rep[v[maybe]]]))
                    np.add.at(links, u[sure], copies[v[sure]])
                    np.add.at(links, v[sure], copies[u[sure]])
                    joined(label, u[sure], v[sure])
        pairs = np.concatenate([np.zeros((2, 0), np.int64), *open_pairs], axis=1)
        own = np.flatnonzero(links)
        a, b = (np.r_[z, w] for z, w in ((pairs.min(0), rep[own]), (pairs.max(0), rep[label[own]])))
        return pa.Table.from_pydict({"a": a, "b": b, "n": pa.array(np.r_[np.zeros(pairs.shape[1], np.int64), links[own]], pa.int64(), mask=np.arange(len(a)) < pairs.shape[1])}, schema=schema)

    tiles = max(TILES, -(-reps.count() // TILE))
    both = coded(reps, tiles).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    both = both.select("*", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")).drop("other")
    return both.groupBy("dims", "i", "j").applyInArrow(compare, "a long, b long, n long")


def verified(pairs: DataFrame, reps: DataFrame, cosine: float) -> DataFrame:
    """Those of the pairs whose cosine in double precision reaches `cosine`."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    most = F.array_max(F.transform("embedding", F.abs))
    even = F.when(most.between(1e-100, 1e100), F.col("embedding")).otherwise(F.transform("embedding", lambda x: x / most))  # squares neither vanish nor overflow
    norm = reps.select("rep", F.col("embedding").cast("array<double>").alias("embedding")).select("rep", even.alias("embedding")).select("rep", "embedding", F.sqrt(dot("embedding", "embedding")).alias("norm"))
    one, two = (norm.select(F.col("rep").alias(k), F.col("embedding").alias(f"e{k}"), F.col("norm").alias(f"n{k}")) for k in "ab")
    both = pairs.join(one, "a").join(two, "b")
    return both.where(dot("ea", "eb") / (F.col("na") * F.col("nb")) >= cosine).select("a", "b")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row; reads vec_id, embedding (of any numeric type).

    Vectors that are null, zero or hold null or non-finite components link with nothing; vectors of different lengths
    neither. Equal vectors are one node with a count, so groups of copies add no pairs. n_links counts every
    other vector with cosine >= `cosine`, copies too.
    """
    spark = vectors.sparkSession
    root = common.shared_folder(spark)
    fine = usable(vectors)
    keyed = fine.select("vec_id", "embedding", F.unhex(F.sha2(F.to_json("embedding"), 256)).alias("key"))
    classes = common.written(keyed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), f"{root}/classes")
    reps = keyed.join(classes.select("rep", F.col("key").alias("same"), "copies"), (F.col("vec_id") == F.col("rep")) & (F.col("key") == F.col("same")))
    reps = common.written(reps.select("rep", "copies", "embedding").dropDuplicates(["rep"]), f"{root}/reps")
    found = common.written(candidates(reps, cosine, blocks), f"{root}/found")
    pairs = common.written(verified(found.where("n is null").select("a", "b"), reps, cosine), f"{root}/pairs")
    both = pairs.union(pairs.select("b", "a"))
    counted = both.join(classes.select(F.col("rep").alias("b"), "copies"), "b").select("a", "copies").union(found.where("n is not null").select("a", "n"))
    other = counted.groupBy("a").agg(F.sum("copies").alias("others"))
    found = common.components(pairs.union(found.where("n is not null").select("a", "b")))
    node = classes.join(other, classes.rep == other.a, "left").join(found, classes.rep == found.id, "left")
    node = node.select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    linked = keyed.select("vec_id", "key").join(node, "key").select("vec_id", "n_links", "component_id")
    alone = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").join(fine.select("vec_id"), "vec_id", "left_anti")
    out = linked.union(alone.select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id
LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = e.vec_id WHERE e.vec_id IS NOT NULL
"""
