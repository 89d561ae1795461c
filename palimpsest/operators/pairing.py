"""Who is like whom: joins of units and of sets by their likeness, and pairs one to one, best first, in rounds of joins.

Units meet in tiles of their keys' rows, sets of words in the row of their scope; a pair is chosen when it is the best of both its ends, which gives what going through all pairs from the best down
would give.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import lineage
from . import align

LETTERS = " etaoinsrhldcumfpgwybvkxjqz0123456789"  # signs that are counted apart; all others together
TILE = 512  # units of each side that are compared in one go
STEPS = (0.85, 0.7)  # ratios down to which pairs are chosen before less like ones are looked for


def one_to_one(pairs: DataFrame, keys: list[str], left: str, right: str, best: list[Column]) -> DataFrame:
    """The rows of pairs that are chosen if, within keys, pairs are taken from the best down and each left and right has one partner.

    best: what is smaller comes first; ties go to the smaller left, then right. Rows whose keys, left or right is null are left out, and of rows alike in all of these
    all are kept or none. Each round chooses the pairs that are first for both their ends and drops what they leave without partner, so the rounds are as many as the longest
    chain of pairs that each wait for the one before; each is written down.
    """
    rank = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(best)), F.col(left).alias("l"), F.col(right).alias("r"))
    named = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).where(" and ".join(f"`{k}` is not null" for k in keys))
    left_rows = lineage.written(named.select(*keys, left, right, rank.alias("_rank")).distinct())
    chosen = []
    while not left_rows.isEmpty():
        first = lambda side, name: left_rows.groupBy(*keys, side).agg(F.min("_rank").alias(name))  # noqa: B023, E731
        a, b = first(left, "_rank").select(*keys, "_rank"), first(right, "_rank").select(*keys, "_rank")
        won = lineage.written(a.join(b, [*keys, "_rank"]).select(*keys, F.col("_rank.l").alias(left), F.col("_rank.r").alias(right)))
        chosen.append(won)
        rest = left_rows.join(won.select(*keys, left), [*keys, left], "left_anti").join(won.select(*keys, right), [*keys, right], "left_anti")
        before, left_rows = left_rows, lineage.written(rest.select(*left_rows.columns))
        lineage.drop(before)
    if not chosen:
        return pairs.limit(0)
    every = chosen[0]
    for won in chosen[1:]:
        every = every.union(won)
    return pairs.join(every, [*keys, left, right], "left_semi")


def histogram(c: Column) -> Column:
    """How often a text has each of LETTERS, then all other signs."""
    counts = F.transform(F.split(F.lit(LETTERS), ""), lambda x: F.length(c) - F.length(F.replace(c, x, F.lit(""))))
    return F.concat(counts, F.array(F.length(c) - F.aggregate(counts, F.lit(0), lambda s, x: s + x)))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The signs of all texts in a row, and the number of the text that each is in."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def _common(old: list[str], new: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of each pair (i, j) of texts, those of old of 64 signs at most: a bit for each sign of the old text."""
    signs, of = _codes(old)
    known, at = np.unique(signs, return_inverse=True)
    place = np.arange(len(signs)) - np.concatenate([[0], np.cumsum([len(t) for t in old])])[of]
    masks = np.zeros((len(old), len(known) + 1), np.uint64)
    np.bitwise_or.at(masks, (of, at), np.uint64(1) << place.astype(np.uint64))
    other, by = _codes(new)
    sizes = np.array([len(t) for t in new])
    held = np.full((len(new), int(sizes.max(initial=0))), len(known))
    found = np.searchsorted(known, other).clip(max=max(0, len(known) - 1))
    held[by, np.arange(len(other)) - np.concatenate([[0], np.cumsum(sizes)])[by]] = np.where(known[found] == other, found, len(known)) if len(known) else 0
    v = np.full(len(i), ~np.uint64(0))
    for k in range(int(sizes[j].max(initial=0))):
        u = v & masks[i, held[j, k]]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v)


def _met(old: list[str], new: list[str], least: float) -> list[tuple[int, int, float]]:
    """(i, j, ratio) of all pairs of a tile whose ratio is `least` or more. A ratio is bounded by the signs that both have, then by the longest common subsequence; what passes is measured."""
    both = [*old, *new]
    signs, of = _codes(both)
    known, at = np.unique(signs, return_inverse=True)
    width = min(64, len(known))
    size = np.array([len(t) for t in both])
    counts = np.bincount(of * width + at % max(1, width), minlength=len(both) * width).reshape(len(both), width).astype(np.uint16 if size.max(initial=0) < 1 << 15 else np.int32)
    a, b, m = counts[: len(old)], counts[len(old) :], len(old)
    shared = np.zeros((len(old), len(new)), counts.dtype)
    for k in range(width):
        shared += np.minimum(a[:, k, None], b[None, :, k])
    total = size[:m, None] + size[None, m:]
    i, j = np.nonzero(2 * shared.astype(np.int64) >= least * total - 1e-9)
    short = size[i] <= 64
    fits = np.ones(len(i), bool)
    for x in range(0, len(i), 1 << 16):
        part = np.arange(x, min(len(i), x + (1 << 16)))
        part = part[short[part]]
        if len(part):
            rows, own = np.unique(i[part], return_inverse=True)
            fits[part] = 2 * _common([old[k] for k in rows], new, own, j[part]).astype(np.int64) >= least * total[i[part], j[part]] - 1e-9
    measured = ((int(x), int(y), align.ratio(old[x], new[y])) for x, y in zip(i[fits].tolist(), j[fits].tolist(), strict=True))
    return [r for r in measured if r[2] >= least]


def _fine(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(" and ".join(f"`{c}` is not null" for c in [*keys, "place", "text"])).where("text <> ''").select(*keys, "place", "text")


def alike_units(old: DataFrame, new: DataFrame, keys: list[str], least: float = align.LEAST_RATIO) -> DataFrame:
    """(keys, old_place, new_place, ratio) of units whose texts' ratio is `least` or more. old, new: keys, place, text; rows with a null among them are left out.

    Units are shuffled once, to the row of their keys, which is cut into tiles of TILE by TILE units; tiles are dealt to all tasks. Of a tile all pairs are bounded at once: longer
    q-grams bound nothing at 0.55, as a pair may share single signs only.
    """
    side = lambda df, s: _fine(df, keys).groupBy(*keys).agg(F.collect_list(F.struct("place", "text")).alias(s))
    tiles = lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / TILE).cast("int")), lambda k: F.slice(c, k * TILE + 1, TILE))
    cut = side(old, "_a").join(side(new, "_b"), keys).select(*keys, F.posexplode(tiles("_a")).alias("_i", "_old"), "_b").select(*keys, "_i", "_old", F.posexplode(tiles("_b")).alias("_j", "_new"))
    out = T.StructType([*(T.StructField(k, old.schema[k].dataType) for k in keys), T.StructField("old_place", old.schema["place"].dataType), T.StructField("new_place", new.schema["place"].dataType), T.StructField("ratio", T.DoubleType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (a, x), (b, y) = ([c[at].values.field(k) for k in range(2)] for c in batch.columns[-2:])
                found = _met(x.to_pylist(), y.to_pylist(), least)
                if found:
                    i, j, r = zip(*found, strict=True)
                    named = [pa.array([c[at].as_py()] * len(found), f.type) for c, f in zip(batch.columns, list(schema)[: len(keys)], strict=False)]
                    yield pa.RecordBatch.from_arrays([*named, a.take(pa.array(i)), b.take(pa.array(j)), pa.array(r, pa.float64())], schema=schema)

    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, for tiles are small and their work is not: they must not be put together by their bytes
    return cut.repartition(parts, *keys, "_i", "_j").select(*keys, "_old", "_new").mapInArrow(run, out)


def _paired(old: DataFrame, new: DataFrame, keys: list[str], least: float) -> DataFrame:
    """The most alike first, in steps: equal texts by place, then what is alike by each of STEPS and by `least`, of units that no step before has paired. So no pair is measured whose
    units have better partners."""
    old, new = _fine(old, keys), _fine(new, keys)
    nth = F.dense_rank().over(Window.partitionBy(*keys, "text").orderBy("place"))
    shown = lambda df, s: df.withColumn("_nth", nth).withColumnRenamed("place", f"{s}_place")
    found = [lineage.written(shown(old, "old").join(shown(new, "new"), [*keys, "text", "_nth"]).select(*keys, "old_place", "new_place", F.lit(1.0).alias("ratio")))]
    spent = []
    for step in [*(x for x in STEPS if x > least), least]:
        left = lambda df, s: lineage.written(df.join(found[-1].select(*keys, F.col(f"{s}_place").alias("place")), [*keys, "place"], "left_anti").select(*df.columns))  # noqa: B023, E731
        old, new = left(old, "old"), left(new, "new")
        spent += [old, new]
        if old.isEmpty() or new.isEmpty():
            break
        pairs = lineage.written(alike_units(old, new, keys, step))
        found.append(lineage.written(one_to_one(pairs, keys, "old_place", "new_place", [-F.col("ratio")])))
        lineage.drop(pairs)
    for df in spent:
        lineage.drop(df)
    return reduce(DataFrame.union, found)


def paired_units(old: DataFrame, new: DataFrame, keys: list[str], least: float = align.LEAST_RATIO, most: int | None = align.PAIR_CAP) -> DataFrame:
    """(keys, old_place, new_place, ratio): the most alike first, ties by place, one to one. keys name a region, place a unit in it. A region of more than `most` pairs is compared place by
    place in order, as long regions are elsewhere; with None none is."""
    if most is None:
        return _paired(old, new, keys, least)
    count = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    wide = count(old, "_a").join(count(new, "_b"), keys).where(F.col("_a") * F.col("_b") > most).select(*keys)
    near, far = ([df.join(wide, keys, how) for df in (old, new)] for how in ("left_anti", "left_semi"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
    listed = [df.withColumn("_nth", nth) for df in far]
    inline = alike_units(*listed, [*keys, "_nth"], least).drop("_nth")
    return _paired(*near, keys, least).union(inline.select(*keys, "old_place", "new_place", "ratio"))


def _alike(old: list[list[str]], new: list[list[str]], least: float) -> Iterator[tuple[int, int, float]]:
    """Pairs of sets of words whose Jaccard similarity is `least` or more, above 0.

    A pair shares ceil(least * n) words of its new set at least, so one among any n - ceil(least * n) + 1 of these: those that the fewest old sets hold are looked up.
    """
    sets, held = [set(x) for x in old], {}
    for i, x in enumerate(sets):
        for w in x:
            held.setdefault(w, []).append(i)
    for j, y in enumerate(map(set, new)):
        m = len(y)
        rare = sorted(y, key=lambda w: len(held.get(w, ())))[: max(0, m - max(1, math.ceil(least * m - 1e-9)) + 1)]
        for i in set().union(*(held[w] for w in rare if w in held)):
            n = len(sets[i])
            if min(n, m) >= least * max(n, m) - 1e-9:
                both = len(sets[i] & y)
                if both and both / (n + m - both) >= least:
                    yield i, j, both / (n + m - both)


def alike_sets(old: DataFrame, new: DataFrame, scope: str, place: str, words: Column, least: float) -> DataFrame:
    """(scope, old_<place>, new_<place>, score): all pairs of a scope whose sets of words have a Jaccard similarity of `least` or more, above 0.

    Sets meet in the row of their scope, which one task holds; each set is shuffled once, its words never by themselves. Null words and empty sets are like nothing.
    """
    sets = F.array_compact(F.array_distinct(words))
    side = lambda df, s: df.where(F.col(scope).isNotNull()).select(scope, F.col(place).alias("_place"), sets.alias("_words")).where(F.size("_words") > 0).groupBy(scope).agg(F.collect_list(F.struct("_place", "_words")).alias(s))
    both = side(old, "_old").join(side(new, "_new"), scope)
    out = T.StructType([T.StructField(scope, old.schema[scope].dataType), T.StructField(f"old_{place}", old.schema[place].dataType), T.StructField(f"new_{place}", new.schema[place].dataType), T.StructField("score", T.DoubleType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            for at in range(batch.num_rows):
                key, a, b = (c[at].as_py() for c in batch.columns)
                for i, j, r in _alike([x["_words"] for x in a], [x["_words"] for x in b], least):
                    rows.append((key, a[i]["_place"], b[j]["_place"], r))
                    if len(rows) >= 20_000:
                        yield made()
        if rows:
            yield made()

    return both.mapInArrow(run, out)
