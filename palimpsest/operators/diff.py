"""Differences of two versions of keyed relations: cells, rows, moves, bags of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values


def cells(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, col, value) of a wide relation; nulls are empty cells and left out."""
    return df.select(F.col(key).alias("key"), *(F.col(c).cast("string").alias(c) for c in columns)).unpivot("key", columns, "col", "value").where("value is not null")


def changes(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """kind, old_value, new_value of each place `on` whose value differs: one full outer join, both sides partitioned alike."""
    both = old.withColumnRenamed("value", "old_value").join(new.withColumnRenamed("value", "new_value"), on, "full_outer")
    kind = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").otherwise("modified")
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).select(*on, kind.alias("kind"), "old_value", "new_value")


def typed(feed: DataFrame) -> DataFrame:
    """With category (number where both sides are numbers, else text), change type and delta."""
    a, b = (F.col(c).try_cast("decimal(28,4)") for c in ("old_value", "new_value"))
    number = F.coalesce(a, b).isNotNull() & (a.isNotNull() | F.col("old_value").isNull()) & (b.isNotNull() | F.col("new_value").isNull())
    feed = feed.withColumn("category", F.when(number, "number").otherwise("text"))
    return feed.withColumns({"change_type": values.change_type(F.col("kind"), F.col("category")), "delta": F.when(number, values.number_delta(a, b))})


def counts(feed: DataFrame, *by: str) -> DataFrame:
    return feed.groupBy(*by).agg(F.count("*").alias("n_changes"), F.count_if(F.col("kind") == "added").alias("n_added"), F.count_if(F.col("kind") == "removed").alias("n_removed"), F.count_if(F.col("kind") == "modified").alias("n_modified"))


def moves(old: DataFrame, new: DataFrame, scope: str, key: str, place: str) -> DataFrame:
    """Equal keys pair first come, first served, within a scope: MOVED where their places differ, SAME where not; the rest REMOVED or ADDED."""
    w = Window.partitionBy(scope, key).orderBy(place)
    side = lambda df, name: df.select(scope, key, F.row_number().over(w).alias("rn"), F.col(place).alias(name))
    both = side(old, "old_place").join(side(new, "new_place"), [scope, key, "rn"], "full_outer")
    kind = F.when(F.col("old_place").isNull(), "added").when(F.col("new_place").isNull(), "removed").when(F.col("old_place") == F.col("new_place"), "same").otherwise("moved")
    return both.select(scope, key, "rn", "old_place", "new_place", kind.alias("kind"))


def bag_overlap(bags: DataFrame, bag: str, value: str) -> DataFrame:
    """(bag_a, bag_b, overlap): multiset Jaccard of bags that share a value: sum of the least over sum of the greatest counts.

    Counts are made before the join, so it has a row for each value and bag at most; bags that share nothing don't meet."""
    n = bags.groupBy(bag, value).agg(F.count("*").alias("n"))
    total = n.groupBy(bag).agg(F.sum("n").alias("total"))
    a, b = (n.select(F.col(bag).alias(f"bag_{s}"), value, F.col("n").alias(f"n_{s}")) for s in "ab")
    shared = a.join(b, value).where("bag_a < bag_b").groupBy("bag_a", "bag_b").agg(F.sum(F.least("n_a", "n_b")).alias("shared"))
    for s in "ab":
        shared = shared.join(total.select(F.col(bag).alias(f"bag_{s}"), F.col("total").alias(f"t_{s}")), f"bag_{s}")
    return shared.select("bag_a", "bag_b", F.round(F.col("shared") / (F.col("t_a") + F.col("t_b") - F.col("shared")), 6).alias("overlap"))


def set_overlap(old: DataFrame, new: DataFrame, scope: str, values_of: Column) -> DataFrame:
    """(scope, jaccard) of the distinct values of two versions; 0 where either is empty."""
    a = old.select(scope, F.array_distinct(values_of).alias("a"))
    b = new.select(scope, F.array_distinct(values_of).alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return a.join(b, scope).select(scope, F.round(F.coalesce(shared / F.nullif(F.size("a") + F.size("b") - shared, F.lit(0)), F.lit(0.0)), 6).alias("jaccard"))


def keyed_or_positional(old: DataFrame, new: DataFrame, table: str, key: str, place: str) -> DataFrame:
    """Rows pair by key where it is unique and non-empty on both sides of their table, else by place."""
    def good(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(table).agg((F.count_if(F.coalesce(key, F.lit("")) == "") + F.count("*") - F.count_distinct(key) == 0).alias(name))

    mode = good(old, "o").join(good(new, "n"), table, "full_outer").select(table, (F.coalesce("o", F.lit(False)) & F.coalesce("n", F.lit(False))).alias("by_key"))
    on = F.when(F.col("by_key"), F.concat(F.lit("k:"), F.col(key))).otherwise(F.concat(F.lit("#"), F.col(place).cast("string")))
    a, b = (df.join(mode, table).select(table, on.alias("pair"), F.col(place).alias(name)) for df, name in ((old, "old_place"), (new, "new_place")))
    return a.join(b, [table, "pair"], "full_outer")
