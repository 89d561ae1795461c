"""Order-preserving alignment of two versions of a sequence of units, one comparison in one row.

Opcodes and ratios are those of the standard library's matcher, which no built-in expression gives. Three shortcuts keep most comparisons
out of Python: equal sequences never reach it (of changes(), nor do equal ends), pairs that can't be chosen aren't measured, and of regions above PAIR_CAP pairs no pairs are held but a few for each text.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter, deque
from collections.abc import Iterator
from difflib import SequenceMatcher
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text, values

LEAST_RATIO, PAIR_CAP, AHEAD = 0.55, 10_000, 8


def matched(a: str, b: str) -> int:
    """The signs in the blocks that the standard library's matcher finds: the longest run of both, of these the first in a, then in b; then so on both sides of it.

    Runs are looked up with the search for strings, which is far faster than a step for each pair of equal signs."""
    total, parts = 0, [(a, b)]
    while parts:
        a, b = parts.pop()
        if not a or not b:
            continue
        size = at = i = 0
        while i + size < len(a):
            if a[i : i + size + 1] in b:
                size, at = size + 1, i
            else:
                i += 1
        if size:
            j = b.find(a[at : at + size])
            total += size
            parts += [(a[:at], b[:j]), (a[at + size :], b[j + size :])]
    return total


def ratio(a: str, b: str) -> float:
    """Of the characters of two keys; keys of fewer than three are alike only if equal."""
    if not a or not b or min(len(a), len(b)) < 3:
        return float(bool(a) and a == b)
    least = 2.0 * min(len(a), len(b)) / (len(a) + len(b))
    if least < LEAST_RATIO or a in b or b in a:
        return least if least >= LEAST_RATIO else 0.0
    if 2.0 * (Counter(a) & Counter(b)).total() / (len(a) + len(b)) < LEAST_RATIO:
        return 0.0  # bounds from above
    return 2.0 * matched(a, b) / (len(a) + len(b))


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, a bit for each sign of a."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    every = (1 << len(a)) - 1
    v = every
    for c in b:
        u = v & masks.get(c, 0)
        if u:
            v = (v + u | v - u) & every
    return len(a) - v.bit_count()


def _bounds(old: list[str], new: list[str]):
    """Bounds of ratio(old[i], new[j]) from above, each closer and dearer than the one before; the last is the ratio."""
    counted: tuple[dict[int, Counter], dict[int, Counter]] = ({}, {})

    def signs(i: int, j: int) -> float:
        x, y = (of[k] if k in of else of.setdefault(k, Counter(text)) for of, k, text in ((counted[0], i, old[i]), (counted[1], j, new[j])))
        return 2.0 * sum(min(n, y[c]) for c, n in x.items() if c in y) / (len(old[i]) + len(new[j]))

    def sizes(i: int, j: int) -> float:
        n, m = len(old[i] or ""), len(new[j] or "")
        return 2.0 * min(n, m) / (n + m) if n and m else 0.0

    return [sizes, signs, lambda i, j: 2.0 * common(old[i], new[j]) / (len(old[i]) + len(new[j])), lambda i, j: ratio(old[i], new[j])]


def best_first(old: list[str], new: list[str]) -> list[tuple[int, int, float]]:
    """Pairs one to one, the most alike first; ties by place. A pair is measured when no other can be more alike, and not at all when one of its units is taken by then."""
    if len(old) * len(new) > PAIR_CAP:
        return _best_by_text(old, new)
    every = [(i, j) for i in range(len(old)) for j in range(len(new))]
    bounds = _bounds(old, new)
    if len(every) == 1:  # there is nothing else that bounds could spare
        r = bounds[0](0, 0) and bounds[-1](0, 0)
        return [(0, 0, r)] if r >= LEAST_RATIO else []
    heap = [(-r, i, j, 0) for i, j in every if (r := bounds[0](i, j)) >= LEAST_RATIO]
    heapify(heap)
    left, right, out = set(), set(), []
    while heap:
        r, i, j, step = heappop(heap)
        if i in left or j in right:
            continue
        if step == len(bounds) - 1:
            left.add(i)
            right.add(j)
            out.append((i, j, -r))
        elif (closer := bounds[step + 1](i, j)) >= LEAST_RATIO:
            heappush(heap, (-closer, i, j, step + 1))
    return out


def _best_by_text(old: list[str], new: list[str]) -> list[tuple[int, int, float]]:
    """best_first() of a large region in memory that goes with its units, not with their pairs: an old text knows its AHEAD best new texts at most, and looks through all anew when the
    units of these are taken. Equal texts are looked through once."""
    left, right = {}, {}
    for side, texts in ((left, old), (right, new)):
        for k, t in enumerate(texts):
            if t:
                side.setdefault(t, deque()).append(k)
    names, sizes = list(right), np.array([len(t) for t in right], np.int64)
    places = list(right.values())
    counted: dict[str, tuple[list[int], list[int]]] = {}
    for b, t in enumerate(names):
        for c, n in Counter(t).items():
            js, ns = counted.setdefault(c, ([], []))
            js.append(b)
            ns.append(n)
    counted = {c: (np.array(js), np.array(ns)) for c, (js, ns) in counted.items()}
    first = np.array([p[0] for p in places], np.int64)  # a new text's first unit not taken
    taken = np.iinfo(np.int64).max
    ahead: dict[str, tuple[list[tuple[float, int]], tuple[float, int] | None]] = {}  # a text's best ones, and what none of the others comes before

    def look(t: str, most: int) -> None:
        shared = np.zeros(len(names), np.int64)
        for c, n in Counter(t).items():
            if c in counted:
                js, ns = counted[c]
                shared[js] += np.minimum(ns, n)
        bound = np.where(first < taken, 2.0 * shared / (len(t) + sizes), 0.0)
        likely = np.flatnonzero(bound >= LEAST_RATIO)
        likely = likely[np.lexsort((first[likely], -bound[likely]))]
        best: list[tuple[float, int, int]] = []
        for b in likely.tolist():
            full = len(best) == most
            if full and (-bound[b], first[b]) > best[-1][:2]:
                break
            least = -best[-1][0] if full else LEAST_RATIO
            if 2.0 * common(t, names[b]) / (len(t) + len(names[b])) >= least and (r := ratio(t, names[b])) >= least:
                insort(best, (-r, int(first[b]), b))
                del best[most:]
        ahead[t] = ([(r, b) for r, _, b in best], best[-1][:2] if len(best) == most else None)

    def head(t: str) -> tuple[float, int, int] | None:
        """The best pair's ratio, negative, its new place and text."""
        for most in (0, AHEAD):
            if most:
                look(t, most)
            known, edge = ahead[t]
            best = min(((r, int(first[b]), b) for r, b in known if first[b] < taken), default=None)
            if edge is None or best is not None and best[:2] <= edge:
                return best
        return best

    heap, out = [], []

    def push(t: str) -> None:
        if left[t] and (best := head(t)):
            heappush(heap, (best[0], left[t][0], best[1], best[2], t))

    for t in left:
        look(t, 1)
        push(t)
    while heap:
        r, i, j, b, t = heappop(heap)
        if first[b] == j:
            out.append((left[t].popleft(), places[b].popleft(), -r))
            first[b] = places[b][0] if places[b] else taken
        push(t)
    return out


def align_units(old: list[str], new: list[str]) -> list[tuple[str, int | None, int | None, float]]:
    """(kind, place in old, place in new, ratio) of two lists of keys: equal, modified, moved, then removed and added."""
    out, gone, come = [], [], []
    for tag, a, b, c, d in SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if tag == "equal":
            out += [("equal", i, j, 1.0) for i, j in zip(range(a, b), range(c, d), strict=True)]
            continue
        pairs = best_first(old[a:b], new[c:d])
        out += [("modified", a + i, c + j, r) for i, j, r in pairs]
        paired = ({i for i, _, _ in pairs}, {j for _, j, _ in pairs})
        gone += [i for i in range(a, b) if i - a not in paired[0]]
        come += [j for j in range(c, d) if j - c not in paired[1]]
    where: dict[str, list[int]] = {}
    for j in come:
        where.setdefault(new[j], []).append(j)
    moved = {i: where[old[i]].pop(0) for i in gone if where.get(old[i])}
    taken = set(moved.values())
    out += [("moved", i, j, 1.0) for i, j in moved.items()]
    return out + [("removed", i, None, 0.0) for i in gone if i not in moved] + [("added", None, j, 0.0) for j in come if j not in taken]


def word_runs(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """(from, to, from, to) of the words that differ, capitals apart; an end is one past the last word."""
    a, b = [w.lower() for w in old], [w.lower() for w in new]
    return [runs for tag, *runs in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag != "equal"]


def word_segments(old: str, new: str) -> list[tuple[str, str]]:
    a, b = old.split(), new.split()
    return [(" ".join(a[i:j]), " ".join(b[k:m])) for i, j, k, m in word_runs(a, b)]


_SEGMENTS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("old", "new")] + [T.StructField(n, T.IntegerType()) for n in ("old_from", "old_to", "new_from", "new_to")]))


def _segments(old: str | None, new: str | None) -> list[dict]:
    a, b = (old or "").split(), (new or "").split()
    return [{"old": " ".join(a[i:j]), "new": " ".join(b[k:m]), "old_from": i, "old_to": j, "new_from": k, "new_to": m} for i, j, k, m in word_runs(a, b)]


@F.pandas_udf(_SEGMENTS)
def segments(old: pd.Series, new: pd.Series) -> pd.Series:
    """The runs of words in which two texts differ, with their places among the words of each; texts should be normalised. A null text has no words."""
    return pd.Series([_segments(a, b) for a, b in zip(old, new, strict=True)])


def _aligned(both: DataFrame, changed: bool) -> DataFrame:
    """The comparisons of both: (scope, _old, _new), each side a scope's units in order, structs of place p, normalised text t and key k. changed: without what is equal, with the texts of a pair."""
    texts = [T.StructField(n, T.StringType()) for n in ("old_text", "new_text")] if changed else []
    out = T.StructType([T.StructField("scope", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("old_place", T.LongType()), T.StructField("new_place", T.LongType()), T.StructField("ratio", T.DoubleType()), T.StructField("segments", _SEGMENTS), *texts])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            for at, sid in enumerate(batch.column(0).to_pylist()):
                units = []
                for c in (1, 2):
                    held = batch.column(c)[at].values
                    if held is None or len(held) == 0:
                        units.append(([], [], []))
                        continue
                    p, t, k = (held.field(f).to_pylist() for f in range(3))
                    if p[0] is None:  # units without a place come last
                        order = sorted(range(len(p)), key=lambda x: p[x] is None)  # noqa: B023
                        p, t, k = ([c[x] for x in order] for c in (p, t, k))
                    units.append((p, t, k))
                (p, s_old, x), (q, s_new, y) = units
                for kind, i, j, r in align_units(x, y):
                    if changed and kind == "equal":
                        continue
                    row = (sid, kind, None if i is None else p[i], None if j is None else q[j], r, _segments(s_old[i], s_new[j]) if kind == "modified" else [])
                    rows.append((*row, None if i is None else s_old[i], None if j is None else s_new[j]) if changed else row)
                    if len(rows) >= 20_000:
                        yield made()
        if rows:
            yield made()

    return both.select(F.col("scope").cast("long").alias("scope"), "_old", "_new").mapInArrow(run, out)


def align(old: DataFrame, new: DataFrame, scope: str = "scope", place: str = "place", key: str = "key", shown: str = "text") -> DataFrame:
    """(scope, kind, old_place, new_place, ratio, segments) of the comparisons whose keys differ. old, new: (scope long, place, text). Segments are runs of words of
    the normalised texts, as segments() gives them.

    Units are compared by their normalised keys and shown by their texts; where the input has a column key already, that one is taken.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        """A row for each scope: its units in order, with their keys where these are not the texts in small letters."""
        fields = [F.col(place).alias("p"), text.normalize(F.col(shown if shown in df.columns else key)).alias("t"), *([F.col(key).alias("k")] if key in df.columns else [])]
        listed = df.select(F.col(scope).alias("scope"), F.struct(*fields).alias("_u")).where("scope is not null").groupBy("scope").agg(F.sort_array(F.collect_list("_u")).alias(name))
        return listed if key in df.columns else listed.withColumn(name, F.transform(name, lambda u: F.struct(u["p"].alias("p"), u["t"].alias("t"), F.lower(u["t"]).alias("k"))))

    both = side(old, "_old").join(side(new, "_new"), "scope", "full_outer")
    return _aligned(both.where("not (_old.p <=> _new.p and _old.k <=> _new.k)"), changed=False)


def _common(a: Column, b: Column) -> Column:
    """How many texts two arrays have in common from the first on."""
    least = F.least(F.size(a), F.size(b))
    return values.once(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int"), lambda at: F.when(at == 0, least).otherwise(F.least(least, at - 1)))


def _between(x: Column) -> Column:
    """struct(old, new) with the units, keyed, between the first and the last texts that are the same in both; with all units where the rest could be aligned with these.

    It can't if no key of the rest is one of theirs, or of the other side's rest: then the matcher, too, takes the first and last ones as they are. If one side has no rest, units
    of both ends could be one run there, which must not be longer than the first ones."""
    old, new = x["old"], x["new"]
    keyed = lambda units: F.transform(units, lambda u: values.once(text.as_normalized(u["t"]), lambda t: F.struct(u["p"].alias("p"), t.alias("t"), F.lower(t).alias("k"))))
    own = lambda units, e: F.slice(units, e["head"] + 1, F.size(units) - e["head"] - e["tail"])

    def chosen(e: Column, y: Column) -> Column:
        ends = F.concat(F.slice(old["t"], F.lit(1), e["head"]), F.slice(old["t"], F.size(old) - e["tail"] + 1, e["tail"]))
        theirs = F.transform(ends, lambda t: F.lower(text.as_normalized(t)))
        apart = lambda a, b: ~F.coalesce(F.arrays_overlap(a, b), F.lit(True))
        a, b = y["old"]["k"], y["new"]["k"]
        two = (F.size(a) > 0) & (F.size(b) > 0) | (e["head"] >= e["tail"])
        alone = values.once(theirs, lambda t: apart(a, t) & apart(b, t)) & apart(a, b)
        return F.when((F.size(a) == 0) & (F.size(b) == 0) | two & alone, y).otherwise(F.struct(keyed(old).alias("old"), keyed(new).alias("new")))

    head = F.struct(_common(old["t"], new["t"]).alias("head"), _common(F.reverse(old["t"]), F.reverse(new["t"])).alias("tail"))
    ends = values.once(head, lambda e: F.struct(e["head"].alias("head"), F.least(e["tail"], F.least(F.size(old), F.size(new)) - e["head"]).alias("tail")))
    return values.once(ends, lambda e: values.once(F.struct(keyed(own(old, e)).alias("old"), keyed(own(new, e)).alias("new")), lambda y: chosen(e, y)))


def changes(both: DataFrame) -> DataFrame:
    """What align() gives but for equal units, with old_text and new_text, the normalised texts of a row's units, so that these need not be joined to it.

    both: (scope long, old, new), one row for each scope, with its units in order as arrays of struct(p long, t string), place and text. Only what lies between the
    texts that both begin and end with is aligned, where that makes no difference.
    """
    side = lambda c: F.coalesce(c, F.array().cast("array<struct<p:bigint,t:string>>")).alias(c)
    cut = both.where("scope is not null").select("scope", values.once(F.struct(side("old"), side("new")), _between).alias("_b"))
    return _aligned(cut.select("scope", F.col("_b.old").alias("_old"), F.col("_b.new").alias("_new")), changed=True)
