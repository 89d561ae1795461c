"""Words around a change, and the price wording that belongs to it; headings and tables that hold prices."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# What counts as an amount, and the wording of usual and of reduced prices.
AMOUNT = r"(?:US\$|[₹$€£¥]|(?<![A-Za-z])(?:Rs\.?|INR|USD|EUR|GBP|JPY)(?![A-Za-z]))\s?\d[\d,]*(?:\.\d+)?|(?<![\w.])\d[\d,]*(?:\.\d+)?\s?(?:USD|EUR|GBP|INR|JPY)(?![A-Za-z])"
ORIGINAL = [r"was", r"originally", r"original(?: price)?", r"regular(?: price)?", r"reg\.", r"list price", r"compare[- ]at(?: price)?", r"m\.?r\.?p\.?", r"rrp", r"retail price", r"usual price"]
SALE = [r"now", r"on sale", r"sale(?: price)?", r"offer(?: price)?", r"special (?:price|offer)", r"deal(?: price)?", r"promo(?:tional)?(?: price)?", r"discount(?:ed)?(?: price)?", r"you save", r"save", r"limited[- ]time(?: offer)?", r"intro(?:ductory)? price", r"off"]
MONEY_RADIUS, MARKER_RADIUS, AVAILABILITY_RADIUS = 1, 3, 2  # words either side


def _wording(phrases: list[str]) -> re.Pattern:
    return re.compile(rf"(?<!\w)(?:{'|'.join(phrases)})(?!\w)", re.IGNORECASE)


KINDS = [("original_price", _wording(ORIGINAL)), ("discount", _wording(SALE))]
MONEY = re.compile(AMOUNT, re.IGNORECASE)


def changed_window(words: Column, first: Column, last: Column, radius: int) -> Column:
    """struct(text, start, stop): words number first to last (from 1; null: all) and `radius` either side, joined by spaces, with the
    place of the changed ones in it (characters from 0, stop exclusive). No words: null."""
    n = F.size(words)
    a = F.greatest(F.coalesce(first, F.lit(1)), F.lit(1))
    b = F.least(F.coalesce(last, n), n)
    low = F.greatest(a - radius, F.lit(1))
    joined = lambda x, y: F.array_join(F.slice(words, x, F.greatest(y - x + 1, F.lit(0))), " ")
    start = F.when(a > low, F.length(joined(low, a - 1)) + 1).otherwise(0)
    made = F.struct(joined(low, F.least(b + radius, n)).alias("text"), start.alias("start"), (start + F.length(joined(a, b))).alias("stop"))
    return F.when((n > 0) & (a <= b), made)


def marker(text: str, start: int, stop: int) -> tuple[str, str] | None:
    """(kind, wording) nearest to the change, what stands before it first; wording beyond another amount belongs to that one."""
    left, right = -1, len(text) + 1  # wording must end after left, or start before right
    for m in MONEY.finditer(text):
        if m.end() <= start:
            left = m.start()
        elif m.start() >= stop:
            right = min(right, m.end())
    near = []
    for k, (kind, pattern) in enumerate(KINDS):
        for m in pattern.finditer(text):
            if left < m.end() <= start:
                near.append((start - m.end(), 0, k, kind, m.group()))
            elif stop <= m.start() < right and m.end() > stop:
                near.append((m.start() - stop, 1, k, kind, m.group()))
    return min(near)[3:] if near else None


@F.pandas_udf(StructType([StructField("kind", StringType()), StructField("wording", StringType())]))
def nearest_marker(window: pd.DataFrame) -> pd.DataFrame:
    """Of changed_window; nulls where no wording belongs to the change."""
    found = [marker(t, int(a), int(b)) if isinstance(t, str) else None for t, a, b in zip(window["text"], window["start"], window["stop"], strict=True)]
    return pd.DataFrame([x or (None, None) for x in found], columns=["kind", "wording"])


def has_amount(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + AMOUNT), F.lit(False))


def priced_places(units: DataFrame) -> DataFrame:
    """(page, section, table), different ones only: the innermost heading over an amount and the table around it (null: none).

    units: page, role, text, section (array of heading ids), table. Amounts in headings and links name no place.
    """
    inner = F.when(F.size("section") > 0, F.element_at("section", -1))
    held = units.where(F.coalesce(~F.col("role").isin("heading", "link"), F.lit(True)) & has_amount(F.col("text")))
    return held.select("page", inner.alias("section"), "table").where("section is not null or table is not null").distinct()
