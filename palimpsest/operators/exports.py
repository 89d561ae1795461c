"""A change feed as reports: blocks of plain text or HTML, in order, that a text sink writes one after another.

A report is never put together in one value: its blocks are rows (comparison_id, seq, block), so its size is bounded by nothing
but the disk. Sort by comparison_id and seq and write with write.text, partitioned by comparison_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column of the feed, its label, the HTML element that holds it.
FIELDS = [("where_old", "Where (original)", ""), ("where_new", "Where (revised)", ""), ("before", "Before", "del"), ("after", "After", "ins"), ("difference", "Difference", ""), ("evidence_old", "Evidence (original)", "q"), ("evidence_new", "Evidence (revised)", "q")]
LAST = (1 << 63) - 1


def escaped(value: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(plain), F.lit(entity))
    return value


def _given(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) != ""


def text_block(seq: Column) -> Column:
    """Of one change; empty fields have no line."""
    lines = [F.when(_given(c), F.concat(F.lit(f"   {label}: " + '"' * (tag == "q")), F.col(c).cast("string"), F.lit('"' * (tag == "q")))) for c, label, tag in FIELDS]
    head = F.concat(seq.cast("string"), F.lit(". "), F.coalesce("change", F.lit("")), F.lit(" ("), F.coalesce("kind", F.lit("")), F.lit(")"))
    return F.concat_ws("\n", head, *lines)


def html_block(seq: Column) -> Column:
    """Of one change, every value escaped."""
    wrap = lambda tag, x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>")) if tag else x
    fields = [F.when(_given(c), F.concat(F.lit(f"<dt>{label}</dt>"), wrap("dd", wrap(tag, escaped(F.col(c).cast("string")))))) for c, label, tag in FIELDS]
    head = wrap("h3", F.concat(seq.cast("string"), F.lit(". "), escaped(F.coalesce("change", F.lit(""))), F.lit(" "), wrap("small", escaped(F.coalesce("kind", F.lit(""))))))
    return wrap("article", F.concat(head, wrap("dl", F.concat_ws("", *fields))))


def report_blocks(feed: DataFrame, comparisons: DataFrame, html: bool = False) -> DataFrame:
    """(comparison_id, seq, block): a head with title and number of changes (seq 0), the changes by their seq, a foot.

    feed: comparison_id, seq (from 1), change, kind and the FIELDS; comparisons: comparison_id, title, each once. Comparisons
    without a change have a head and a foot. The feed is read once for its counts and once for its blocks; only counts shuffle.
    """
    n = comparisons.select("comparison_id", "title").join(feed.groupBy("comparison_id").agg(F.count("*").alias("n")), "comparison_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    number = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " change").otherwise(" changes"))
    title = F.coalesce("title", F.lit(""))
    if html:
        head = F.concat(F.lit('<!doctype html><html lang="en"><meta charset="utf-8"><title>'), escaped(title), F.lit("</title><h1>"), escaped(title), F.lit("</h1><h2>"), number, F.lit("</h2>"))
        foot, block = F.lit("</html>"), html_block(F.col("seq"))
    else:
        head, foot, block = F.concat(title, F.lit("\n"), number), F.lit(""), text_block(F.col("seq"))
    ends = n.select("comparison_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("seq"), head.alias("block")), F.struct(F.lit(LAST).cast("long").alias("seq"), foot.alias("block")))).alias("x")).select("comparison_id", "x.*")
    return ends.unionByName(feed.select("comparison_id", F.col("seq").cast("long").alias("seq"), block.alias("block")))
