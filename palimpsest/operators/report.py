"""Reading a change feed: facets, search, rollups, buckets, segments, word windows, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facet_filter(df: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """OR within a facet, AND across facets; an empty choice filters nothing."""
    for column, values in chosen.items():
        if values:
            df = df.where(F.col(column).isin(values))
    return df


def facet_counts(df: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, n): one pass; every row is counted once for each facet before the shuffle."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets)))
    return df.select(pairs.alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def search(text: Column, query: str) -> Column:
    """Every word of the query occurs, whatever the case."""
    out = F.lit(True)
    for word in query.lower().split():
        out = out & F.lower(text).contains(word)
    return out


def phrase(text: Column, query: str) -> Column:
    return F.lower(text).contains(query.lower().strip())


def section_totals(df: DataFrame, path: Column) -> DataFrame:
    """(section, depth, n): counts of each section with all below it; path: an array of names."""
    up = F.transform(F.sequence(F.lit(1), F.size(path)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(path, 1, k), "/").alias("section")))
    return df.where(F.size(path) > 0).select(F.explode(up).alias("x")).groupBy("x.section", "x.depth").agg(F.count("*").alias("n"))


def dense_buckets(df: DataFrame, place: Column) -> DataFrame:
    """(bucket, n, intensity) from 1 to the last place, empty ones too; intensity: share of the fullest."""
    n = df.groupBy(place.cast("int").alias("bucket")).agg(F.count("*").alias("n")).where("bucket >= 1")
    every = n.agg(F.max("bucket").alias("m"), F.max("n").alias("most")).where("m is not null").select(F.explode(F.sequence(F.lit(1), "m")).alias("bucket"), "most")
    return every.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.col("most"), 6).alias("intensity"))


def window_of(words: Column, at: Column, radius: int) -> Column:
    """The words around place `at` (from 1)."""
    first = F.greatest(F.lit(1), at - radius)
    return F.slice(words, first, at + radius - first + 1)


def segments(size: Column, marks: Column) -> Column:
    """Stretches of a text of `size` characters, cut at every end of a mark (struct start, stop, id), with the ids that cover each."""
    edge = lambda x: F.least(F.greatest(x, F.lit(0)), size)
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), size), F.transform(marks, lambda m: edge(m["start"])), F.transform(marks, lambda m: edge(m["stop"])))))
    pairs = F.filter(F.transform(cuts, lambda c, k: F.struct(c.alias("start"), F.get(cuts, k + 1).alias("stop"))), lambda p: p["stop"].isNotNull())
    return F.transform(pairs, lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), F.array_sort(F.transform(F.filter(marks, lambda m: (m["start"] <= p["start"]) & (m["stop"] >= p["stop"])), lambda m: m["id"])).alias("ids")))


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """A report's first k of each group; the window filter keeps k rows a task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """left with the value of the last row of right at or before it: one sort of both together, no join."""
    both = left.select("*", F.lit(1).alias("_side"), F.lit(None).alias("_value")).unionByName(right.select(by, at, F.lit(0).alias("_side"), F.col(value).alias("_value")), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"last_{value}", F.last("_value", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_value")


def steps(feed: DataFrame, by: str, order: str) -> DataFrame:
    """feed with previous and next (values of the order column), place and total long: where a reader stands in a comparison."""
    w = Window.partitionBy(by).orderBy(order)
    return feed.withColumns({"previous": F.lag(order).over(w), "next": F.lead(order).over(w), "place": F.row_number().over(w).cast("long"), "total": F.count("*").over(Window.partitionBy(by))})


def highlights(cells: DataFrame, by: list[str], seq: str, value: str) -> DataFrame:
    """(by..., seq, value): of the changes that name a cell, the first one marks it."""
    return cells.groupBy(*by).agg(F.min(F.struct(seq, value)).alias("_first")).select(*by, f"_first.{seq}", f"_first.{value}")


def page_groups(feed: DataFrame, by: list[str], seq: str, anchor: Column) -> DataFrame:
    """feed with group: the first page record (anchor) of the same place and kind takes in the others; without one, each change is its own group."""
    first = feed.where(anchor).groupBy(*by).agg(F.min(seq).alias("_anchor"))
    return feed.join(first, by, "left").withColumn("group", F.coalesce("_anchor", seq)).drop("_anchor")


def scrolled(positions: DataFrame, anchors: DataFrame, by: str) -> DataFrame:
    """positions (by, y) with to double: where y lies on the other side, straight between the anchors around it, and as far from the outermost one
    beyond them. anchors: (by, y, to), one for a y. Null without anchors."""
    both = positions.select(by, F.col("y").cast("double").alias("y"), F.lit(None).cast("double").alias("to"), F.lit(1).alias("asked")).unionByName(anchors.select(by, F.col("y").cast("double").alias("y"), F.col("to").cast("double").alias("to"), F.lit(0).alias("asked")))
    w = Window.partitionBy(by).orderBy("y", "asked")
    at = F.when(F.col("asked") == 0, F.struct("y", "to"))
    around = both.withColumns({"lo": F.last(at, True).over(w), "hi": F.first(at, True).over(w.rowsBetween(1, Window.unboundedFollowing))}).where("asked = 1")
    lo, hi, y = F.col("lo"), F.col("hi"), F.col("y")
    between = lo["to"] + (y - lo["y"]) / (hi["y"] - lo["y"]) * (hi["to"] - lo["to"])
    to = F.when(lo.isNull(), hi["to"] + y - hi["y"]).when(hi.isNull(), lo["to"] + y - lo["y"]).otherwise(between)
    return around.select(by, "y", to.alias("to"))
