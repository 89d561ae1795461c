"""Suffix-array dedup (operator 8): repeated byte strings of a fixed length, by bucket-pointer refinement.

Which strings can be equal is found by anchors: of the q-grams of each SPAN-byte window the one with the least hash, so equal windows have equal
anchors at equal offsets. An anchor's q-gram is the initial bucket. Buckets of one anchor (found with two Bloom filters)
hold nothing and end there; the others' windows meet in one task and are refined: positions of a bucket are sorted by the bucket identifiers of
positions one step later, the step doubling with each round, until buckets are of SPAN bytes. Identifiers made in one round are
the sort keys of the next; buckets of one position leave. A bucket too large for one task is refined the same way by a sort of all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeat_filter

SPAN, GRAM = 100, 32
BATCH, HELD, ROUND = 4 << 20, 32 << 20, 4 << 20  # bytes of texts scanned at a time, of windows held by a map task, and refined together
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of the byte strings of length gram at each position, built by doubling."""
    table = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
    power, have, out, size = table[data], 1, None, 0
    factor = MULTIPLY
    while True:
        if gram & have:
            if out is None:
                out, size = power, have
            else:
                n = len(data) - size - have + 1
                out, size = out[:n] * factor + power[size : size + n], size + have
        if 2 * have > gram:
            break
        n = len(data) - 2 * have + 1
        power = power[:n] * factor + power[have : have + n]
        factor = np.uint64(int(factor) ** 2 % (1 << 64) | 1)
        have *= 2
    out = out ^ out >> np.uint64(29)
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def anchors(data: np.ndarray, starts: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """For texts laid end to end, from starts (and the end): runs of windows with one anchor, as (first window, last window, anchor, hash).

    Of equal hashes in a window the leftmost is its anchor. Windows that reach into the next text are left out."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if len(data) < span:
        return none
    h = gram_hashes(data, gram)
    low = h & np.uint64(0xFFFFFFFF000000) << np.uint64(8) | np.arange(len(h), dtype=np.uint64)
    width, least, have = span - gram + 1, low, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(low) - width + 1], least[width - have : len(low) - have + 1])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(at) + 1, np.int32)
    sizes = np.diff(starts)
    fit = sizes >= span
    np.add.at(inside, starts[:-1][fit], 1)
    np.add.at(inside, starts[1:][fit] - span + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    if not inside.any():
        return none
    change = np.r_[True, (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])]
    change[starts[1:-1][starts[1:-1] < len(at)]] = True
    first = np.flatnonzero(change)
    last = np.r_[first[1:], len(at)] - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    return first, last, at[first], h[at[first]]


def refine(data: np.ndarray, windows: np.ndarray, span: int, gram: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(windows, bucket) of those window starts whose span bytes recur at another of them; equal bytes, equal bucket.

    A position whose bucket is its own alone is dead, and with it every longer string that holds it."""
    view = np.lib.stride_tricks.sliding_window_view(data, gram)
    active, key, have = np.arange(len(view)), np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64), gram
    rank = np.empty(len(data), np.int64)
    while True:
        order = np.argsort(key)
        ordered = key[order]
        ident = np.empty(len(order), np.int64)
        ident[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        alive = np.bincount(ident, minlength=1)[ident] > 1
        active, ident = active[alive], ident[alive]
        rank[:] = -1
        rank[active] = ident
        if have == span or not len(active):
            break
        step = min(have, span - have)
        active = active[active + step < len(data)]
        active = active[rank[active + step] >= 0]
        if have + step == span:
            active = np.intersect1d(active, windows, assume_unique=True)
        key = rank[active].astype(np.uint64) << np.uint64(32) | rank[active + step].astype(np.uint64)
        have += step
    found = rank[windows]
    return windows[found >= 0], found[found >= 0]


#: hash, document, place of the anchor, windows' bytes before it, and the windows' bytes; or with no bytes, a span to remove from `at`, `left` long.
ROWS = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("at", pa.int64()), ("left", pa.int32()), ("bytes", pa.binary())])
ROWS_DDL = "hash long, doc_id long, tie long, at long, left int, bytes binary"
SPANS = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
SPANS_DDL = "doc_id long, tie long, start long, stop long"
ANCHORS = pa.schema([("range", pa.int32()), ("h", pa.int64()), ("sure", pa.bool_()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("at", pa.int64())])
ANCHORS_DDL = "range int, h long, sure boolean, doc_id long, tie long, at long"
TOGETHER = 5000  # window runs of one anchor that a task refines by itself; buckets of more are refined by a sort of all tasks


def scanned(batch: pa.RecordBatch, span: int, gram: int) -> Iterator[tuple]:
    """((doc_id, tie) of each, bytes laid end to end, starts, and their anchors) for parts of a batch of (doc_id, tie, text)."""
    ids, raw = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), batch.column(2).cast(pa.binary()).to_pylist()
    a = 0
    while a < len(raw):
        b, size = a, 0
        while b < len(raw) and (b == a or size + len(raw[b]) <= BATCH):
            size, b = size + len(raw[b]), b + 1
        data = np.frombuffer(b"".join(raw[a:b]), np.uint8)
        starts = np.r_[0, np.cumsum([*map(len, raw[a:b])])]
        yield ids[a:b], data, starts, *anchors(data, starts, span, gram)
        a = b


def window_runs(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """ROWS of runs of windows whose anchor is suspected to recur. Runs that a task sees again end there: only the first of equal ones is sent on.

    docs: (doc_id, tie, text). The suspected anchors are known from filters that every task holds or, where these are too large for that,
    from a list of places for each document."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64)] + [_occurrences(x[5], x[6]) for x in scanned(batch, span, gram)])

    twice = repeat_filter.twice_seen(docs, hashes, 2 * size // (span - gram))
    test = twice.tester() if twice.held is not None else None
    if test is None:
        docs = with_places(docs, twice, span, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple, tuple] = {}
        spans: list[tuple] = []
        kept = 0
        for batch in batches:
            done = 0
            for ids, data, starts, lo, hi, at, h in scanned(batch, span, gram):
                text = data.tobytes()
                where = np.searchsorted(starts, lo, "right") - 1
                if test is not None:
                    own = np.flatnonzero(test(h))
                else:
                    known = [(base + np.frombuffer(x.as_py() or b"", np.int64)) for base, x in zip(starts, batch.column(3).slice(done, len(ids)), strict=False)]
                    own = np.flatnonzero(np.isin(at, np.concatenate(known)))
                    done += len(ids)
                for d, a, b, p, x in zip(where[own].tolist(), lo[own].tolist(), hi[own].tolist(), at[own].tolist(), h[own].view(np.int64).tolist(), strict=True):
                    part, place = text[a : b + span], (*ids[d], p - int(starts[d]))
                    key = (x, p - a, hashlib.blake2b(part, digest_size=16).digest())
                    was = first.get(key)
                    if was is None:
                        first[key] = (*place, part)
                        kept += len(part) + 200
                    elif was[:3] != place:
                        if place < was[:3]:
                            first[key], place = (*place, part), was[:3]
                        spans.append((x, *place[:2], place[2] - (p - a), len(part), None))
                        kept += 100
                if kept > HELD:
                    yield from _batches([(k[0], *v[:3], k[1], v[3]) for k, v in first.items()] + spans, ROWS)
                    first, spans, kept = {}, [], 0
        yield from _batches([(k[0], *v[:3], k[1], v[3]) for k, v in first.items()] + spans, ROWS)

    return docs.mapInArrow(run, ROWS_DDL)


def with_places(docs: DataFrame, twice: repeat_filter.Twice, span: int, gram: int) -> DataFrame:
    """(doc_id, tie, text, places binary): the places of a document's suspected anchors, found by dealing hashes to their filters."""
    ranges = twice.ranges

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, starts, _, _, at, h in scanned(batch, span, gram):
                if not len(at):
                    continue
                once = np.r_[True, at[1:] != at[:-1]]
                at, h = at[once], h[once]
                _, back, times = np.unique(h, return_inverse=True, return_counts=True)
                sure = times[back] > 1
                to = np.where(sure, np.arange(len(h)) % ranges, repeat_filter.range_of(h, ranges)).astype(np.int32)
                where = np.searchsorted(starts, at, "right") - 1
                own = np.array(ids, np.int64)[where]
                cols = [to, h.view(np.int64), sure, own[:, 0], own[:, 1], at - starts[where]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), f.type) for c, f in zip(cols, ANCHORS, strict=True)], schema=ANCHORS)

    found = twice.suspected(docs.mapInArrow(send, ANCHORS_DDL))
    packed = F.unhex(F.array_join(F.transform(F.collect_set("at"), _little_endian), ""))
    return docs.join(found.groupBy("doc_id", "tie").agg(packed.alias("places")), ["doc_id", "tie"], "left").select("doc_id", "tie", "text", "places")


def _little_endian(x):
    """Sixteen hex digits of a long's bytes from the lowest."""
    h = F.lpad(F.hex(x), 16, "0")
    return F.concat(*(F.substring(h, k, 2) for k in range(15, 0, -2)))


def _occurrences(at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes of anchors, each place once."""
    return h[np.r_[True, at[1:] != at[:-1]]] if len(at) else h


def _batches(rows: list[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), size):
        some = rows[k : k + size]
        yield pa.RecordBatch.from_pydict({n: [r[c] for r in some] for c, n in enumerate(schema.names)}, schema=schema)


def repeats_together(runs: DataFrame, span: int) -> DataFrame:
    """SPANS of windows that start earlier elsewhere, among runs of windows dealt and sorted by anchor."""
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, distinct, spans = None, {}, []
        queue: list[list[tuple]] = []
        size = 0

        def close() -> None:
            nonlocal size
            if len(distinct) > 1:
                queue.append([(*place, left, part) for (left, part), place in distinct.items()])
                size += sum(len(x[4]) for x in queue[-1])

        for batch in batches:
            for h, i, tie, p, left, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != anchor:
                    close()
                    anchor, distinct = h, {}
                    if size > ROUND:
                        spans += _refined(queue, span)
                        queue, size = [], 0
                was = distinct.setdefault((left, part), (i, tie, p))
                if was != (i, tie, p):
                    spans.append((i, tie, p - left, p - left + len(part)))
            if len(spans) > 10_000:
                yield from _batches(spans, SPANS)
                spans = []
        close()
        yield from _batches(spans + _refined(queue, span), SPANS)

    return runs.repartition(n, "hash").sortWithinPartitions("hash", "doc_id", "tie", "at").mapInArrow(run, SPANS_DDL)


def _refined(queue: list[list[tuple]], span: int) -> list[tuple]:
    """Spans of recurring windows among different runs of windows, each list those of one anchor in order of place."""
    flat = [x for runs in queue for x in runs]
    if not flat:
        return []
    data = np.frombuffer(b"".join(x[4] for x in flat), np.uint8)
    size = np.array([len(x[4]) for x in flat])
    base = np.cumsum(size) - size
    windows = np.concatenate([np.arange(b, b + n - span + 1) for b, n in zip(base, size, strict=True)])
    found, bucket = refine(data, windows, span)
    if not len(found):
        return []
    run = np.searchsorted(base, found, "right") - 1
    shift = np.array([x[2] - x[3] for x in flat]) - base  # from data to document
    names, doc = np.unique(np.array([x[:2] for x in flat], np.int64), axis=0, return_inverse=True)  # in order of (doc_id, tie)
    doc, start = doc.ravel()[run], found + shift[run]
    order = np.lexsort((start, doc, bucket))
    b, d, s = bucket[order], doc[order], start[order]
    leader = np.maximum.accumulate(np.where(np.r_[True, b[1:] != b[:-1]], np.arange(len(b)), 0))
    again = (d != d[leader]) | (s != s[leader])
    d, s = d[again], s[again]
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    if not len(d):
        return []
    cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)])
    last = np.r_[cut[1:], len(d)] - 1
    return list(zip(*names[d[cut]].T.tolist(), s[cut].tolist(), (s[last] + span).tolist(), strict=True))


def repeats_apart(runs: DataFrame, span: int, gram: int) -> DataFrame:
    """The same for buckets of very many runs: each window's bucket is refined by the identifiers of the q-grams at later offsets that
    cover it (their 64-bit hashes), and the least place of a refined bucket is a minimum, combined before the shuffle.

    Places of a refined bucket that are not its least one go out as spans. The join back is on the refined bucket; a bucket that many windows
    share is a skewed key, which adaptive execution splits."""
    offsets = [*range(0, span - gram, gram), span - gram]
    ids = [f"g{k}" for k in range(len(offsets))]
    schema = pa.schema([*((g, pa.int64()) for g in ids), *SPANS])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, tie, at, left = (batch.column(k).to_numpy() for k in (1, 2, 3, 4))
            raw = batch.column(5).to_pylist()
            size = np.array([*map(len, raw)])
            base = np.cumsum(size) - size
            h = gram_hashes(np.frombuffer(b"".join(raw), np.uint8), gram).view(np.int64)
            run = np.repeat(np.arange(len(raw)), size - span + 1)
            first = np.arange(len(run)) - np.repeat(np.cumsum(size - span + 1) - (size - span + 1), size - span + 1)
            start = (at - left)[run] + first
            cols = [*(h[base[run] + first + o] for o in offsets), own[run], tie[run], start, start + span]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

    windows = runs.mapInArrow(single, ", ".join(f"{g} long" for g in ids) + ", " + SPANS_DDL)
    first = windows.groupBy(*ids).agg(F.min(F.struct("doc_id", "tie", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select(*ids, "first")
    again = windows.join(first, ids).where("doc_id <> first.doc_id or tie <> first.tie or start <> first.start")
    return again.select("doc_id", "tie", "start", "stop")


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, tie, start, stop), in bytes: strings of span bytes or longer that also start earlier; they may overlap. docs: (doc_id, tie, text)."""
    runs = common.written(window_runs(docs, span, gram), common.shared_folder(docs.sparkSession))
    direct = runs.where("bytes is null").select("doc_id", "tie", F.col("at").alias("start"), (F.col("at") + F.col("left")).alias("stop"))
    rest = runs.where("bytes is not null")
    counts = rest.groupBy("hash").agg(F.count("*").alias("n"))
    large = common.written(counts.where(F.col("n") > TOGETHER).select("hash"), common.shared_folder(docs.sparkSession))
    if large.isEmpty():
        return direct.union(repeats_together(rest, span))
    return direct.union(repeats_together(rest.join(large, "hash", "left_anti"), span)).union(repeats_apart(rest.join(large, "hash", "left_semi").select(*ROWS.names), span, gram))


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for each row; reads doc_id, text (null: empty).

    Earlier: a smaller doc_id, or in the same document a smaller offset. Rows that share a doc_id and text count as one document;
    each gets the result. Rows that share a doc_id but not a text are documents of their own, in order of a hash of the text. Texts under span
    bytes stay whole. span is at least gram, gram at least 8.
    """
    docs = common.told_apart(docs)
    spans = repeated_spans(docs, span, gram).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in schema.names}
            for i, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                data, kept, at, n = text.encode(), [], 0, 0
                end = None
                for a, b in sorted((x["start"], x["stop"]) for x in spans or ()):
                    if end is None or a > end:
                        n += 1
                        kept.append(data[at:a])
                        end = at = b
                    else:
                        end = at = max(end, b)
                left = b"".join(kept) + data[at:]
                for name, value in zip(out, (i, len(data), len(data) - len(left), n, left), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return docs.join(spans, ["doc_id", "tie"], "left").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(common.documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
