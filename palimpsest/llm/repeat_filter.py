"""Two Bloom filters, of hashes seen once and of hashes seen twice, dealt by ranges of hashes.

Tasks send their different hashes, eight bytes each, and those that they saw again. A range's task fills its pair of filters in one
pass: a hash that the first filter has already goes to the second. The second filter misses no repeat; it also holds a few
hashes seen once, which callers confirm exactly. A range has about RANGE_KEYS hashes and BITS_PER_KEY bits for each, at every size of
the input. Filters of SENT bytes together go to all tasks; more stay in the shared folder, and what is to be looked up is dealt to them by range.

Where few hashes are repeated, as with lines, a list of the suspected ones is far smaller than the filters that told them: a range's task tests the hashes that it was sent once more when its
filters are full, and keeps those of the second. Then this list is what goes to all tasks, if SENT bytes hold it: the upper four bytes of each, so of 16 million listed ones, the most
there can be, a lone hash is taken for one in 0.4 % of cases, no more often than by the filters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RANGE_KEYS, BITS_PER_KEY, PROBES, HELD, SENT = 1 << 20, 12, 3, 1 << 22, 64 << 20
PACKED = pa.schema([("range", pa.int32()), ("once", pa.binary()), ("again", pa.binary())])
FILTER = pa.schema([("range", pa.int32()), ("twice", pa.binary()), ("listed", pa.binary())])


def places(h: np.ndarray, bits: int, ranges: int) -> list[np.ndarray]:
    """The bits of each hash in its range's filter."""
    own = h // np.uint64(ranges)
    step = (own >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    return [((own + np.uint64(i) * step) >> np.uint64(7)) % np.uint64(bits) for i in range(PROBES)]


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return (h % np.uint64(ranges)).astype(np.int32)


def _packed(h: np.ndarray, ranges: int) -> pa.RecordBatch:
    h, n = np.unique(h, return_counts=True)
    parts = []
    for some in (h, h[n > 1]):
        r = range_of(some, ranges)
        order = np.argsort(r, kind="stable")
        parts.append((some[order], np.searchsorted(r[order], np.arange(ranges + 1))))
    used = np.flatnonzero(np.diff(parts[0][1]))
    cols = [[x[cut[k] : cut[k + 1]].tobytes() for k in used] for x, cut in parts]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], schema=PACKED)


class Twice:
    """The second filters of a table: `ranges` of them, `bits` each, as rows (range, twice, listed) in the shared folder; listed: the upper four bytes of the suspected hashes themselves, or null.

    held: what goes to all tasks, or None where that is over SENT bytes."""

    def __init__(self, filters: DataFrame, folder: str, bits: int, ranges: int, listed: bool):
        self.filters, self.folder, self.bits, self.ranges, self.listed = filters, folder, bits, ranges, listed
        self.held = None
        if listed:
            if (filters.agg(F.sum(F.octet_length("listed"))).first()[0] or 0) <= SENT:
                found = np.frombuffer(b"".join(bytes(r[0]) for r in filters.select("listed").collect()), np.uint32)
                self.held = filters.sparkSession.sparkContext.broadcast(np.unique(found).tobytes())
        elif ranges * bits // 8 <= SENT:
            whole = np.zeros(ranges * bits // 8, np.uint8)
            for k, twice in filters.select("range", "twice").collect():
                whole[k * bits // 8 : (k + 1) * bits // 8] = np.frombuffer(twice, np.uint8)
            self.held = filters.sparkSession.sparkContext.broadcast(whole.tobytes())

    def tester(self) -> Callable[[np.ndarray], np.ndarray]:
        """Of hashes, which are suspected repeats; where the filters were sent. To be pickled with a task."""
        held, bits, ranges = self.held, self.bits, self.ranges

        def known(h: np.ndarray) -> np.ndarray:
            all_known = np.frombuffer(held.value, np.uint32)
            h = _upper(h)
            return all_known[np.minimum(np.searchsorted(all_known, h), len(all_known) - 1)] == h if len(all_known) else np.zeros(len(h), bool)

        if self.listed:
            return known

        def test(h: np.ndarray) -> np.ndarray:
            whole, base = np.frombuffer(held.value, np.uint8), range_of(h, ranges).astype(np.uint64) * np.uint64(bits)
            return _has(whole, [base + p for p in places(h, bits, ranges)])

        return test

    def suspected(self, rows: DataFrame) -> DataFrame:
        """Those of the rows (range int, h long, sure boolean, ...) that are sure or whose h is a suspected repeat; columns after `sure`.

        Rows are dealt to their range's filter. Callers mark hashes that a batch has twice as sure and give these any range, so no hash
        brings its range more rows than there are batches."""
        names = rows.columns
        schema, bits, ranges = rows.schema, self.bits, self.ranges
        out = pa.schema([(f.name, t) for f, t in zip(schema.fields[3:], _arrow(schema)[3:], strict=True)])
        both = self.filters.select("range", F.lit(0).alias("kind"), "twice", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[1:]))
        both = both.union(rows.select("range", F.lit(1), F.lit(None).cast("binary"), *names[1:]))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, twice = None, None
            for b in batches:
                r, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
                cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                for a, e in zip(cuts, [*cuts[1:], len(r)], strict=True):
                    if r[a] != now:
                        now, twice = r[a], np.zeros(bits // 8, np.uint8)
                    if kind[a] == 0:
                        twice, a = np.frombuffer(b.column(2)[int(a)].as_py(), np.uint8), a + 1
                    some = b.slice(a, e - a)
                    if len(some):
                        ok = some.column(4).to_numpy(zero_copy_only=False).astype(bool)
                        rest = np.flatnonzero(~ok)
                        ok[rest] = _has(twice, places(some.column(3).to_numpy()[rest].view(np.uint64), bits, ranges))
                        yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in some.columns[5:]], schema=out)

        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = both.repartition(n, "range").sortWithinPartitions("range", "kind")
        return dealt.mapInArrow(probe, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[3:]))

    def drop(self) -> None:
        common.drop_folder(self.filters.sparkSession, self.folder)


def _upper(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def _arrow(schema) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


def _has(bitmap: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    found = np.ones(len(at[0]), bool)
    for p in at:
        found &= (bitmap[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def twice_seen(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], keys: int, listed: bool = False) -> Twice:
    """hashes: all hashes (uint64) of a batch, one for each occurrence that counts; keys: how many there are in all, about; listed: whether to list the suspected ones.

    For the list a range's task holds what it was sent, eight bytes for each hash and each batch that has it."""
    spark = df.sparkSession
    ranges = max(1, -(-keys // RANGE_KEYS))
    bits = max(1 << 12, -(-keys * BITS_PER_KEY // ranges // 8) * 8)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in common.slices(batches):
            held.append(hashes(batch))
            size += len(held[-1])
            if size >= HELD:
                yield _packed(np.concatenate(held), ranges)
                held, size = [], 0
        if size:
            yield _packed(np.concatenate(held), ranges)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = once = twice = None
        sent: list[bytes] = []

        def done() -> pa.RecordBatch:
            found = np.frombuffer(b"".join(sent), np.uint64)
            found = np.unique(_upper(found[np.logical_and.reduce([twice[p] for p in places(found, bits, ranges)])])).tobytes() if listed else None
            return pa.RecordBatch.from_pydict({"range": [now], "twice": [np.packbits(twice, bitorder="little").tobytes()], "listed": [found]}, schema=FILTER)

        for batch in batches:
            for r, new, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != now:
                    if now is not None:
                        yield done()
                    now, once, twice = r, np.zeros(bits, bool), np.zeros(bits, bool)
                    sent.clear()
                if listed:
                    sent.append(new)
                h = np.frombuffer(new, np.uint64)
                at = places(h, bits, ranges)
                seen = once[at[0]] & once[at[1]] & once[at[2]]
                for p in at:
                    twice[p[seen]] = True
                    once[p] = True
                for p in places(np.frombuffer(again, np.uint64), bits, ranges):
                    twice[p] = True
        if now is not None:
            yield done()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.mapInArrow(send, "range int, once binary, again binary").repartition(n, "range").sortWithinPartitions("range")
    folder = common.shared_folder(spark)
    return Twice(common.written(dealt.mapInArrow(fill, "range int, twice binary, listed binary"), folder), folder, bits, ranges, listed)
