"""SimHash near-dedup (operator 9): byte-position inverted index with count filtering.

Two 64-bit fingerprints at most `bits` apart share at least 8 - bits of their eight positional bytes. Posting lists are kept not
for single positional bytes, which a 256th of all fingerprints share, but for sets of positions such that any 8 - bits positions
hold one of the sets. Within a list the shared positional bytes of each pair are tallied, pairs below 8 - bits are dropped, the
rest verified. A list longer than LONG is refined by further positions until its fingerprints differ in few bits, whose
combinations are then looked up, so no list is ever compared pair by pair at length.

Texts that share 0.8 to 0.9 of their shingles differ in 4 to 14 of those bits, which guarantees no shared byte. `similar_groups`
therefore adds to the fingerprint a sketch of further positional bytes, each the lowest byte of the least of the shingles' hashes
under one multiplier, which two texts share as often as shingles; they go through the same index and tally, and every link found
either way is confirmed on the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED, LONG = 42, 512
SKETCH, BYTES, LISTS, SLACK, TILE = 128, 4, 12, 12, 16_384  # positional bytes; of a key; keys of a text; tally below the mean; rows held
BLOCK = 1024  # rows of a long list that are compared with as many others at once
LINK, MEMBER = 0, 1
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(text: str, words: int) -> list[bytes]:
    """Fewer words: the whole sequence; no word: none."""
    w = text.encode().lower().split()
    return [b" ".join(x) for x in zip(*(w[k:] for k in range(words)), strict=False)] if len(w) > words else [b" ".join(w)] if w else []


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles in order, in arrays of bounded length."""
    shingles, digest = shingles_of(text, words), xxhash.xxh64_intdigest
    for a in range(0, len(shingles), 1 << 16):
        yield np.array([digest(s, SEED) for s in shingles[a : a + (1 << 16)]], "<u8")


def majority(hashes: list[np.ndarray]) -> int:
    """The bits that over half of the hashes have; without hashes 0."""
    count, votes = sum(map(len, hashes)), np.zeros(64, np.int64)
    for h in hashes:
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > count, bitorder="little").tobytes(), "little")


def fingerprint(text: str, words: int = 3) -> int:
    """Of shingles of so many words, repeats included; a bit is 1 if over half of their hashes have it. No word: 0."""
    return majority([*shingle_hashes(text, words)])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long); fp has the 64 bits of the fingerprint."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    one = lambda t: (x := fingerprint(t, words)) - (x >> 63 << 64)
    return common.map_batches(common.texts(docs), lambda b: {"doc_id": b.column(0), "fp": [one(t) for t in b.column(1).to_pylist()]}, schema, "doc_id long, fp long")


def position_sets(bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions, one of which any 8 - bits positions hold: joins of all but `bits` of bits + 2 blocks of positions."""
    if not 0 <= bits <= 5:
        raise ValueError("0 to 5 differing bits")
    cut = [round(8 * k / (bits + 2)) for k in range(bits + 3)]
    blocks = [range(a, b) for a, b in zip(cut, cut[1:], strict=False)]
    return [tuple(p for b in some for p in b) for some in combinations(blocks, 2)]


def _mask(positions) -> int:
    return sum(255 << 8 * p for p in positions)


def links(fp: np.ndarray, fixed: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at most `bits` apart in one posting list (distinct, sharing the bytes at `fixed`), enough to connect the list
    as all its pairs do."""
    n = len(fp)
    if n <= LONG:
        i, j = np.triu_indices(n, 1)
        x = fp[i] ^ fp[j]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)  # the tally of positional bytes
        ok = shared >= 8 - bits
        ok[ok] = np.bitwise_count(x[ok]) <= bits
        yield i[ok], j[ok]
        return
    free = [p for p in range(8) if p not in fixed]
    if len(free) <= max(2, bits):  # few bits differ: look up each fingerprint with up to `bits` of them changed
        order = np.argsort(fp)
        known = fp[order]
        places = [8 * p + b for p in free for b in range(8)]
        for k in range(1, bits + 1):
            for some in combinations(places, k):
                want = fp ^ np.uint64(sum(1 << b for b in some))
                at = np.minimum(np.searchsorted(known, want), n - 1)
                hit = np.flatnonzero((known[at] == want) & (fp < want))
                if len(hit):
                    yield hit, order[at[hit]]
        return
    for more in combinations(free, len(free) - bits):  # of the free positions, so many are shared
        mask = np.uint64(_mask(more))
        order = np.argsort(fp & mask, kind="stable")
        key = (fp & mask)[order]
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                own = order[a:b]
                for i, j in links(fp[own], fixed + more, bits):
                    yield own[i], own[j]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Of all pairs, those that join two trees: n - 1 at most."""
    parent, out = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in pairs:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
    return out


def near_fingerprints(reps: DataFrame, bits: int) -> DataFrame:
    """(a long, b long): links between fingerprints at most `bits` apart, enough to connect them as all such links do.

    reps: (fp long, rep long), each fingerprint once. A posting row is 25 bytes for each set of positions; lists are read in
    sorted order, one in memory at a time, and each gives fewer links than it has rows.
    """
    sets = position_sets(bits)
    rows = reps.select(F.explode(F.array(*(F.struct(F.lit(k).cast("byte").alias("s"), F.col("fp").bitwiseAND(F.lit(m - (m >> 63 << 64)).cast("long")).alias("key")) for k, m in enumerate(map(_mask, sets))))).alias("x"), "fp", "rep")
    rows = rows.select("x.s", "x.key", "fp", "rep")
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in range(4)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            s, key, *_ = now
            cuts = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (key[1:] != key[:-1])])
            last = cuts[-1]
            held = [x[last:] for x in now]
            if last:
                yield lists([x[:last] for x in now], np.r_[cuts])
        if held is not None:
            yield lists(held, np.array([0, len(held[0])]))

    def lists(cols: list[np.ndarray], cuts: np.ndarray) -> pa.RecordBatch:
        s, _, fp, rep = cols
        fp, a, b = fp.view(np.uint64), [], []
        size = np.diff(cuts)
        for k in np.flatnonzero(size > 1):
            lo, hi = cuts[k], cuts[k + 1]
            for i, j in forest(hi - lo, links(np.ascontiguousarray(fp[lo:hi]), sets[s[lo]], bits)):
                a.append(rep[lo + i])
                b.append(rep[lo + j])
        return pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=schema)

    return rows.repartition(n, "s", "key").sortWithinPartitions("s", "key").mapInArrow(tally, "a long, b long")


def groups(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs; reads doc_id, text (null: empty).

    Documents of equal fingerprints, empty ones too (fingerprint zero), are one node from the start, named by
    their smallest doc_id, so copies add no pairs. component_id: the smallest doc_id reachable by links.
    """
    spark = docs.sparkSession
    fps = common.written(fingerprints(docs, words), common.shared_folder(spark))
    reps = common.written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), common.shared_folder(spark))
    found = common.components(near_fingerprints(reps, bits))
    classes = reps.join(found, reps.rep == found.id, "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    out = fps.join(classes, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketch(hashes: np.ndarray) -> bytes:
    """SKETCH positional bytes of a set of hashes; all 255 without one."""
    least = np.full(SKETCH, (1 << 64) - 1, np.uint64)
    for a in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[a : a + 4096] * MULTIPLIERS[:, None]).min(1))
    return (least & np.uint64(255)).astype(np.uint8).tobytes()


def _set(hashes: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)


def hash_set(text: str, words: int) -> np.ndarray:
    """The different shingle hashes of a text, sorted."""
    return _set([*shingle_hashes(text, words)])


def signature(text: str, words: int) -> tuple[int, bytes, bytes]:
    """Fingerprint (signed), sketch, and a digest of 128 bits of the set of shingle hashes."""
    hashes = [*shingle_hashes(text, words)]
    own = _set(hashes)
    fp = majority(hashes)
    return fp - (fp >> 63 << 64), sketch(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def heaviest_forest(x: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Index pairs of the rows of bytes x that share at least so many, enough to connect as all such pairs do, best pairs first.

    Up to LONG rows compare pair by pair. Of more, the row nearest to the commonest bytes is compared with all of them, and those
    it meets, itself included, lead no further.
    """
    links, left = [], np.arange(len(x))
    while len(left) > LONG:
        common_bytes = np.array([np.bincount(c, minlength=256).argmax() for c in x[left].T], np.uint8)
        lead = left[(x[left] == common_bytes).sum(1).argmax()]
        met = np.flatnonzero((x == x[lead]).sum(1) >= least)
        links += [(min(lead, k), max(lead, k)) for k in met.tolist() if k != lead]
        left = left[~np.isin(left, met)]
    i, j = left[tallied(x[left], least)]
    return links + forest(len(x), iter([(i, j)]))


def tallied(x: np.ndarray, least: int) -> np.ndarray:
    """All index pairs of the rows of bytes x that share at least so many, in two rows, best pairs first."""
    found = [np.zeros((3, 0), np.int64)]
    for a in range(len(x) - 1):
        tally = np.count_nonzero(x[a + 1 :] == x[a], axis=1)
        b = np.flatnonzero(tally >= least)
        found.append(np.array([-tally[b], np.full(len(b), a), a + 1 + b], np.int64))
    pairs = np.concatenate(found, axis=1)
    return pairs[1:, np.lexsort(pairs[::-1])]


def similar_sketches(nodes: DataFrame, similarity: float) -> DataFrame:
    """(a long, b long, kind byte): pairs of reps of which the tally of shared sketch bytes says that they may have the similarity.

    nodes: (sketch binary, rep long). Posting lists are those of LISTS keys of BYTES positional bytes; pairs of similarity 0.8 miss
    all lists in one case of 500. LINK pairs connect a list as all its pairs do; they are tried first. As a try may fail, a list that
    may have other pairs also gives their rows (MEMBER: rep, number of the list) for `crossing_links`. A list is read in tiles of TILE rows, of which LONG go over to the next tile.
    """
    n, least = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(SKETCH * similarity) - SLACK
    keys = F.array(*(F.struct(F.lit(k).cast("byte").alias("s"), F.expr(f"substring(sketch, {1 + k * BYTES}, {BYTES})").alias("key")) for k in range(LISTS)))
    rows = nodes.select(F.explode(keys).alias("x"), "sketch", "rep").select("x.s", "x.key", "sketch", "rep")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.int8())])

    def batch(a: np.ndarray, b: np.ndarray, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": a, "b": b, "kind": np.full(len(a), kind, np.int8)}, schema=schema)

    def pairs(rows: list[tuple[bytes, int]], known: int, ended: bool, name: tuple[int, bytes]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        x, rep = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, SKETCH), np.array([r[1] for r in rows], np.int64)
        if ended and not known and len(rows) <= LONG:
            every = tallied(x, least)
            found = np.array(forest(len(x), iter([every])), np.int64).reshape(-1, 2)
            own = np.unique(every) if every.shape[1] > len(found) else np.zeros(0, np.int64)
        else:
            found, own = np.array(heaviest_forest(x, least), np.int64).reshape(-1, 2), np.arange(known, len(rows))
        yield batch(rep[found[:, 0]], rep[found[:, 1]], LINK)
        number = xxhash.xxh64_intdigest(bytes([name[0]]) + name[1], SEED)
        yield batch(rep[own], np.full(len(own), number - (number >> 63 << 64), np.int64), MEMBER)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known = None, [], 0
        for some in batches:
            for s, key, own, rep in zip(*(c.to_pylist() for c in some.columns), strict=True):
                ended = (s, key) != now
                if ended or len(held) == TILE:
                    yield from pairs(held, known, ended, now)
                    now, held = (s, key), [] if ended else held[:LONG]
                    known = len(held)
                held.append((own, rep))
        yield from pairs(held, known, True, now)

    return rows.repartition(n, "s", "key").sortWithinPartitions("s", "key", "rep").mapInArrow(tally, "a long, b long, kind byte")


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets of hashes share at least that part of their different members."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def crossing_links(members: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a long, b long): links between different components of a list, enough to connect it as all its links do.

    members: (list long, rep long, c long), c the component. Lists of one component have no such pair. The others are cut into tiles
    of BLOCK rows at the mean, and each pair of tiles is compared by itself: pairs whose tally says that they may have the similarity
    are checked on their shingle hashes in place, unless links found before join them already, so a task gives fewer links than it has rows.
    """
    spark = nodes.sparkSession
    n, least = int(spark.conf.get("spark.sql.shuffle.partitions")), int(SKETCH * similarity) - SLACK
    mixed = members.groupBy("list").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("t")).where("lo <> hi")
    rows = members.join(mixed.select("list", "t"), "list").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("t")).cast("int"))
    rows = common.written(rows, common.shared_folder(spark))
    reps = common.written(rows.select(F.col("rep").alias("doc_id")).distinct(), common.shared_folder(spark))
    schema = pa.schema([("rep", pa.int64()), ("hashes", pa.binary())])
    hashed = lambda b: {"rep": b.column(0), "hashes": [hash_set(t, words).tobytes() for t in b.column(1).to_pylist()]}
    sets = common.map_batches(common.only(common.texts(docs), reps), hashed, schema, "rep long, hashes binary").dropDuplicates(["rep"])
    sets = common.written(sets.join(nodes.select("rep", "sketch"), "rep"), common.shared_folder(spark))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    rows = rows.select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "c", "rep")
    rows = rows.join(sets, "rep").select("list", "i", "j", "left", "c", "rep", "sketch", "hashes")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        left, c, rep = (np.array([r[k] for r in rows]) for k in range(3))
        out: list[tuple[int, int]] = []
        if len(rows) > 1 and not (c == c[0]).all():
            x = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, SKETCH)
            one_tile, place = left.all(), np.arange(len(rows))
            for a in np.flatnonzero(left):
                b = np.flatnonzero((c != c[a]) & (place > a if one_tile else ~left))
                for k in b[np.count_nonzero(x[b] == x[a], axis=1) >= least]:
                    if c[k] != c[a] and alike(np.frombuffer(rows[a][4], np.uint64), np.frombuffer(rows[k][4], np.uint64), similarity):
                        out.append((rep[a], rep[k]))
                        c[c == c[k]] = c[a]
        return pa.RecordBatch.from_pydict({"a": [p for p, _ in out], "b": [q for _, q in out]}, schema=schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for some in batches:
            for number, i, j, *row in zip(*(c.to_pylist() for c in some.columns), strict=True):
                if (number, i, j) != now:
                    yield compare(held) if held else pa.RecordBatch.from_pydict({"a": [], "b": []}, schema=schema)
                    now, held = (number, i, j), []
                held.append(row)
        if held:
            yield compare(held)

    return rows.repartition(n, "list", "i", "j").sortWithinPartitions("list", "i", "j").mapInArrow(blocks, "a long, b long")


def distinct_links(links: DataFrame) -> DataFrame:
    """(a, b), a < b, each once, written down."""
    return common.written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), common.shared_folder(links.sparkSession))


def confirmed(links: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links (a, b) whose texts share at least that part of their different shingles (of their 64-bit hashes). Reads a text once for each link.
    Of rows of docs that repeat a doc_id, one."""
    spark = docs.sparkSession
    ends = common.written(links.select(F.col("a").alias("doc_id")).union(links.select(F.col("b").alias("doc_id"))).distinct(), common.shared_folder(spark))
    own = common.only(common.texts(docs), ends).dropDuplicates(["doc_id"])
    t = common.written(own, common.shared_folder(spark)).select("doc_id", "text")
    both = links.join(t.toDF("a", "x"), "a").join(t.toDF("b", "y"), "b").select("a", "b", "x", "y")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(b: pa.RecordBatch) -> dict:
        ok = pa.array([alike(hash_set(x, words), hash_set(y, words), similarity) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
        return {"a": b.column(0).filter(ok), "b": b.column(1).filter(ok)}

    return common.map_batches(both, check, schema, "a long, b long")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs; reads doc_id, text (null: empty).

    Links are pairs of texts that share at least that part of their different shingles (Jaccard), looked for among fingerprints at
    most `bits` apart and among sketches, and confirmed on the texts. First come links that would connect each posting list; then every
    other pair of sketches that a list tallies and whose ends the confirmed ones leave apart, as a rejected link says nothing of them. Texts of the same
    set of shingles are one node. Texts without a word are alike. doc_id names a text: rows that repeat one must have its text.
    """
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("sketch", pa.binary()), ("same", pa.binary())])

    def one(batch: pa.RecordBatch) -> dict:
        found = [signature(t, words) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0)} | {n: [x[k] for x in found] for k, n in enumerate(schema.names[1:])}

    fps = common.written(common.map_batches(common.texts(docs), one, schema, "doc_id long, fp long, sketch binary, same binary"), common.shared_folder(spark))
    nodes = fps.groupBy("same").agg(F.min(F.struct("doc_id", "fp", "sketch")).alias("x"))
    nodes = common.written(nodes.select("same", F.col("x.doc_id").alias("rep"), "x.fp", "x.sketch"), common.shared_folder(spark))
    heads = common.written(nodes.groupBy("fp").agg(F.min("rep").alias("rep")), common.shared_folder(spark))
    same = nodes.join(heads.toDF("fp", "head"), "fp").where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b"))
    alike = common.written(similar_sketches(nodes, similarity), common.shared_folder(spark))
    links = distinct_links(same.union(near_fingerprints(heads, bits)).union(alike.where(f"kind = {LINK}").select("a", "b")))
    first = common.written(confirmed(links, docs, words, similarity), common.shared_folder(spark))
    found = common.components(first)
    members = alike.where(f"kind = {MEMBER}").select(F.col("b").alias("list"), F.col("a").alias("rep"))
    members = members.join(found.toDF("rep", "c"), "rep", "left").select("list", "rep", F.coalesce("c", "rep").alias("c"))
    second = distinct_links(crossing_links(common.written(members, common.shared_folder(spark)), nodes, docs, words, similarity))
    if not second.isEmpty():
        found = common.components(first.union(second))
    classes = nodes.join(found, nodes.rep == found.id, "left").select("same", F.coalesce("component_id", "rep").alias("component_id"))
    out = fps.join(classes, "same")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    return groups(common.documents(spark, sf_dir))
