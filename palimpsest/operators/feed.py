"""A change feed as a report: noise apart, counts in a fixed order, reading order, numbers without gaps, annotations.

A feed has a boolean `noise`; numbers and ranks are given within one comparison, whose size the limits of the sources bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shown(feed: DataFrame, with_noise: bool = False) -> DataFrame:
    """The changes a reader sees; a change whose noise is null is meaningful."""
    return feed if with_noise else feed.where(~F.coalesce("noise", F.lit(False)))


def counts(feed: DataFrame, *by: str) -> DataFrame:
    """(by..., total, meaningful, n_noise)."""
    minor = F.coalesce("noise", F.lit(False))
    return feed.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(~minor).alias("meaningful"), F.count_if(minor).alias("n_noise"))


def counts_in_order(feed: DataFrame, column: str, known: list[str]) -> DataFrame:
    """(place, value, n): the known values in their order, also those never seen, then the others by name; a null value is 'other'."""
    n = feed.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("other")).alias("value")).agg(F.count("*").alias("n"))
    rules = feed.sparkSession.createDataFrame([(k, v) for k, v in enumerate(known, 1)], "place long, value string")
    both = rules.join(n, "value", "full_outer")
    # values beyond the known ones are few: one row each after the count
    rest = F.row_number().over(Window.orderBy(F.col("place").isNotNull(), "value")) + len(known)
    return both.select(F.coalesce("place", rest).cast("long").alias("place"), "value", F.coalesce("n", F.lit(0)).alias("n"))


def affected(feed: DataFrame, by: str, **places: str) -> DataFrame:
    """(by, name...): how many different values each of the named columns has, nulls apart."""
    return feed.groupBy(by).agg(*(F.count_distinct(c).alias(n) for n, c in places.items()))


def first_seen(feed: DataFrame, by: str, value: str, seq: str) -> DataFrame:
    """(by, value, first, rank long): different values in the order in which they are first seen."""
    least = feed.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.min(seq).alias("first"))
    return least.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("first", value)).cast("long"))


def reading_order(old_page: str = "old_page", new_page: str = "new_page", seq: str = "seq") -> list[Column]:
    """By the page of the new side, else of the old one, without a page last; then by seq."""
    return [F.coalesce(new_page, old_page).asc_nulls_last(), F.col(seq).asc()]


def numbered(feed: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """feed with number long: 1 to n in each comparison, meaningful changes before noise."""
    w = Window.partitionBy(by).orderBy(F.coalesce("noise", F.lit(False)), *order)
    return feed.withColumn("number", F.row_number().over(w).cast("long"))


def renumbered(feed: DataFrame, by: str, seq: str, keep: Column) -> DataFrame:
    """The changes that are kept, with seq from 1 without gaps in the order it had."""
    return feed.where(keep).withColumn(seq, F.row_number().over(Window.partitionBy(by).orderBy(seq)).cast("long"))


def within(section: Column, chosen: str) -> Column:
    """The section chosen, written with slashes, or one below it."""
    return (section == chosen) | section.startswith(f"{chosen}/")


def anchored(feed: DataFrame, found: DataFrame, page: list[str], ids: list[str], anchor: Column) -> DataFrame:
    """found, and the records of whole pages (anchor) of the pages that it has changes of, but those found already. page and ids: the columns that
    tell pages and changes apart."""
    pages = feed.where(anchor).join(found.select(*page).distinct(), page, "left_semi")
    return found.unionByName(pages.join(found.select(*ids).distinct(), ids, "left_anti"))


def attached(annotations: DataFrame, feed: DataFrame, key: str, order: list[str]) -> DataFrame:
    """annotations with problem: unknown_change, duplicate (not the first of its change in the order), or null, which are those to join."""
    known = feed.select(key).distinct().withColumn("_known", F.lit(True))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    both = annotations.withColumn("_rank", rank).join(known, key, "left")
    return both.withColumn("problem", F.when(F.col("_known").isNull(), "unknown_change").when(F.col("_rank") > 1, "duplicate")).drop("_known", "_rank")


def selected(feed: DataFrame, by: str, first: Column, order: list[Column], most: int) -> DataFrame:
    """The changes to explain, at most so many of a comparison: those of the first kind before others, then in reading order.
    Adds place long, the reading order among the selected ones."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy((~F.coalesce(first, F.lit(False))).cast("int"), *order))
    top = shown(feed).withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
    return top.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))


def withheld(answers: DataFrame, reason: str, **usage: str) -> DataFrame:
    """(reason, n, sums...): how often each reason kept an answer back ('given' without one), and what was used."""
    return answers.groupBy(F.coalesce(reason, F.lit("given")).alias("reason")).agg(F.count("*").alias("n"), *(F.sum(c).cast("long").alias(n) for n, c in usage.items()))
