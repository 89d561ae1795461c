"""State that expires: loads of a cache for each origin, captures against the baseline before them. Each has a batch form, which says the same of a table as the stream says of its rows in
order of time.

The streams keep one value for each key in a state store with a time to live, which needs the RocksDB provider (spark.sql.streaming.stateStore.providerClass). That time is of the clock and
only clears keys that nothing was heard of for long; what a row gives depends on the times in the rows. As time alone can change such state, a query with the trigger availableNow doesn't end
by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LOADS = "key long, id long, t double, load boolean"
CAPTURES = "key long, id long, t double, value string, before string, state string"
WEEK = 7 * 86_400_000


def loads(times: list[float], ttl: float, last: float | None) -> tuple[list[bool], float | None]:
    """Which of the requests in order find nothing in the cache, or something older than ttl, and so load it anew; and when that was last."""
    out = []
    for t in times:
        out.append(last is None or t - last > ttl)
        if out[-1]:
            last = t
    return out, last


def compared(values: list[str | None], before: tuple[str | None] | None) -> tuple[list[tuple[str | None, str]], tuple[str | None] | None]:
    """(value before, first, unchanged or changed) of captures in order, and the last one. before: None where there is no baseline; a null is a value."""
    out = []
    for v in values:
        out.append((None, "first") if before is None else (before[0], "unchanged" if before[0] == v else "changed"))
        before = (v,)
    return out, before


def in_order(rows: DataFrame, step: Callable[[pd.DataFrame, object], tuple[pd.DataFrame, object]], schema: str) -> DataFrame:
    """step(rows of one key, what the step before left) along each key's rows in order of (t, id). A task holds one batch of rows, however many a key has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, left = object(), None
        for batch in batches:
            for key, some in batch.groupby("key", sort=False):
                out, left = step(some, left if key == now else None)
                now = key
                yield out

    return rows.where("key is not null").repartition("key").sortWithinPartitions("key", "t", "id").mapInPandas(run, schema)


def cache_loads(requests: DataFrame, ttl: float) -> DataFrame:
    """requests (key, id, t in seconds) with load: whether it finds its key's entry missing or older than ttl. Only a load renews an entry. Rows without a key or a time are left out."""

    def step(some: pd.DataFrame, last: float | None) -> tuple[pd.DataFrame, float | None]:
        found, last = loads(some["t"].tolist(), ttl, last)
        return some.assign(load=found), last

    return in_order(requests.select("key", "id", "t").where("t is not null"), step, LOADS)


def captures_compared(captures: DataFrame) -> DataFrame:
    """captures (key, id, t, value) with before and state: first, or unchanged or changed against the one before. Rows without a key or a time are left out."""

    def step(some: pd.DataFrame, before: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
        found, before = compared([None if pd.isna(v) else v for v in some["value"]], before)
        return some.assign(before=[b for b, _ in found], state=[s for _, s in found]), before

    return in_order(captures.select("key", "id", "t", "value").where("t is not null"), step, CAPTURES)


class Loads(StatefulProcessor):
    def __init__(self, ttl: float, keep_ms: int) -> None:
        self.ttl, self.keep_ms = ttl, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t double", self.keep_ms)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        some = pd.concat([*rows]).sort_values(["t", "id"])
        found, last = loads(some["t"].tolist(), self.ttl, self.last.get()[0] if self.last.exists() else None)
        self.last.update((last,))
        yield some.assign(load=found)[["key", "id", "t", "load"]]

    def close(self) -> None:
        pass


class Captures(StatefulProcessor):
    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value string", self.keep_ms)

    def handleInitialState(self, key, initial: pd.DataFrame, timer_values) -> None:
        v = initial["value"].iloc[0]
        self.last.update((None if pd.isna(v) else v,))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        some = pd.concat([*rows]).sort_values(["t", "id"])
        found, last = compared([None if pd.isna(v) else v for v in some["value"]], tuple(self.last.get()) if self.last.exists() else None)
        self.last.update(last)
        yield some.assign(before=[b for b, _ in found], state=[s for _, s in found])[["key", "id", "t", "value", "before", "state"]]

    def close(self) -> None:
        pass


def cache_loads_stream(requests: DataFrame, ttl: float, keep_ms: int = WEEK) -> DataFrame:
    """The same over a stream. Rows of one batch are taken in order of time; a row that comes in a later batch than a younger one is judged against that."""
    rows = requests.select("key", "id", "t").where("key is not null and t is not null").groupBy("key")
    return rows.transformWithStateInPandas(statefulProcessor=Loads(ttl, keep_ms), outputStructType=LOADS, outputMode="Append", timeMode="ProcessingTime")


def captures_stream(captures: DataFrame, baseline: DataFrame | None = None, keep_ms: int = WEEK) -> DataFrame:
    """The same over a stream. baseline: (key, value), one row for each key, known before the stream begins; it is read when the stream first starts, and not when it starts again."""
    rows = captures.select("key", "id", "t", "value").where("key is not null and t is not null").groupBy("key")
    known = None if baseline is None else baseline.select("key", F.col("value").cast("string").alias("value")).where("key is not null").groupBy("key")
    return rows.transformWithStateInPandas(statefulProcessor=Captures(keep_ms), outputStructType=CAPTURES, outputMode="Append", timeMode="ProcessingTime", initialState=known)
