"""Limits over time: accepted hits of a sliding window, first of each day, latest capture against now."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import state


def accept(times: list[float], rules: list[tuple[int, float]], history: list[float] = ()) -> tuple[list[bool], list[float]]:
    """Which hits pass rules of (most, seconds) over accepted hits only, and the accepted ones that can still matter."""
    kept, out, widest = deque(history), [], max(s for _, s in rules)
    for t in times:
        while kept and kept[0] <= t - widest:
            kept.popleft()
        ok = all(sum(1 for x in reversed(kept) if x > t - s) < most for most, s in rules)
        out.append(ok)
        if ok:
            kept.append(t)
    return out, list(kept)


def limited(hits: DataFrame, rules: list[tuple[int, float]]) -> DataFrame:
    """hits (key, id, t) with accepted, replayed in order of (t, id) for each key; what is kept between batches of rows is bounded by the rules' counts."""

    def step(some: pd.DataFrame, history: list[float] | None) -> tuple[pd.DataFrame, list[float]]:
        ok, history = accept(some["t"].tolist(), rules, history or ())
        return some.assign(accepted=ok), history

    return state.in_order(hits.select("key", "id", "t"), step, "key long, id long, t double, accepted boolean")


def limited_stream(hits: DataFrame, rules: list[tuple[int, float]]) -> DataFrame:
    """The same over a stream: the state of a key is its accepted hits of the widest window."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def one(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        history = list(held.get[0]) if held.exists else []
        pdf = pd.concat(list(parts)).sort_values(["t", "id"])
        ok, history = accept(pdf["t"].tolist(), rules, history)
        held.update((history,))
        yield pdf.assign(key=key[0], accepted=ok)[["key", "id", "t", "accepted"]]

    return hits.select("key", "id", "t").groupBy("key").applyInPandasWithState(one, "key long, id long, t double, accepted boolean", "accepted array<double>", "append", GroupStateTimeout.NoTimeout)


def daily_budget(hits: DataFrame, time: str, order: str, most: int) -> DataFrame:
    """The first `most` of each UTC day; of times without a zone, of their own day."""
    zoned = dict(hits.dtypes)[time] == "timestamp"
    day = F.floor(F.unix_micros(time) / 86_400_000_000) if zoned else F.to_date(time)
    w = Window.partitionBy(day).orderBy(time, order)
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def deduplicated(hits: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """A stream without repeats within the delay."""
    return hits.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
