"""Structure around changes: paired tables, nearest rows, innermost blocks, messages under headings, topics present, grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pairing

# Least overlap of paired tables; blocks under a heading; bounds of a batch; numbers whose differences are allowed.
TABLE_OVERLAP, MESSAGE_BLOCKS, BATCH_ITEMS, BATCH_CHARS, DIFFERENCES = 0.3, 3, 8, 60_000, 25


def table_overlaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """(scope, old, new, overlap) of tables that share a cell. Sides: (scope, tbl, value), a row for each cell.

    Cells are counted before the join on (scope, value), so a value repeated in a table is one row there.
    """
    count = lambda df, name: df.groupBy("scope", F.col("tbl").alias(name), "value").agg(F.count("*").alias(f"n_{name}"))
    size = lambda df, name: df.groupBy("scope", F.col("tbl").alias(name)).agg(F.count("*").alias(f"all_{name}"))
    shared = count(old, "old").join(count(new, "new"), ["scope", "value"]).groupBy("scope", "old", "new").agg(F.sum(F.least("n_old", "n_new")).alias("both"))
    sized = shared.join(size(old, "old"), ["scope", "old"]).join(size(new, "new"), ["scope", "new"])
    return sized.select("scope", "old", "new", (F.col("both") / (F.col("all_old") + F.col("all_new") - F.col("both"))).alias("overlap"))


def paired_tables(overlaps: DataFrame, least: float = TABLE_OVERLAP) -> DataFrame:
    """One-to-one pairs of each scope, best overlap first, then nearest places."""
    return pairing.one_to_one(overlaps.where(F.col("overlap") >= least), ["scope"], "old", "new", [-F.col("overlap"), F.abs(F.col("old") - F.col("new"))])


def nearest_rows(rows: DataFrame) -> DataFrame:
    """rows (scope, place, mapped: place on the other side or null) with `counterpart`: one after that of the last mapped row, else 1."""
    w = Window.partitionBy("scope").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("counterpart", F.coalesce("mapped", F.last("mapped", ignorenulls=True).over(w) + 1, F.lit(1)))


def innermost(links: DataFrame, blocks: DataFrame) -> DataFrame:
    """links (scope, link, path) with `block`, the longest block path above theirs. A path meets its own prefixes by an equality join."""
    parts = F.split("path", "/")
    ups = links.withColumn("_up", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))
    known = blocks.select("scope", F.col("path").alias("_up"), F.col("path").alias("_block")).distinct()
    return ups.join(known, ["scope", "_up"], "left").groupBy("scope", "link", "path").agg(F.max_by("_block", F.length("_block")).alias("block"))


def messages(units: DataFrame, most: int = MESSAGE_BLOCKS) -> DataFrame:
    """(scope, heading, message): each scope's first heading and the blocks right under it. Units: scope, place, is_heading, text."""
    upto = Window.partitionBy("scope").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    under = units.withColumn("_h", F.count_if("is_heading").over(upto)).where("_h = 1")
    under = under.withColumn("_n", F.row_number().over(Window.partitionBy("scope").orderBy("place"))).where(F.col("_n") <= most + 1)
    return under.groupBy("scope").agg(F.max(F.when(F.col("is_heading"), F.col("text"))).alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("place", "text")))), lambda u: u["text"]), " | ").alias("message"))


def topic_presence(changed: DataFrame, present: DataFrame, topics: list[str]) -> DataFrame:
    """(topic, status, n_changed), every topic: changed, present or not_found. Inputs have a row for each topic of an item."""
    both = changed.select("topic", F.lit(1).alias("c")).union(present.select("topic", F.lit(0))).groupBy("topic").agg(F.sum("c").alias("n"), F.count("*").alias("all"))
    named = changed.sparkSession.createDataFrame([(t,) for t in topics], "topic string")
    status = F.when(F.col("n") > 0, "changed").when(F.col("all") > 0, "present").otherwise("not_found")
    return named.join(both, "topic", "left").select("topic", status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n_changed"))


def numbers(text: Column) -> Column:
    """Numbers of a text, thousands separators left out."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)")), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("decimal(28,6)"))


def ungrounded(statement: Column, material: Column) -> Column:
    """Numbers of a statement that are neither in its material nor a difference of two of the first numbers there."""
    known = F.filter(numbers(material), lambda x: x.isNotNull())
    first = F.slice(known, 1, DIFFERENCES)
    gaps = F.flatten(F.transform(first, lambda a: F.transform(first, lambda b: F.abs(a - b).cast("decimal(28,6)"))))
    return F.array_except(F.filter(numbers(statement), lambda x: x.isNotNull()), F.array_union(known, gaps))


def batches(items: DataFrame, most: int = BATCH_ITEMS, chars: int = BATCH_CHARS) -> DataFrame:
    """items (scope, place, size) with `batch`, from 0, in order: a batch closes when it has `most` items or would pass `chars`.

    A scope's items are one comparison's selected changes, whose sizes alone are folded in the JVM; an item too large fills a batch of its own.
    """
    start = F.struct(F.lit(-1).alias("batch"), F.lit(most).alias("n"), F.lit(0).cast("long").alias("chars"), F.array().cast("array<struct<place:bigint,batch:int>>").alias("out"))

    def step(s, x):
        full = (s["n"] >= most) | (s["chars"] + x["size"] > chars)
        now = F.when(full, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(now.alias("batch"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.when(full, x["size"]).otherwise(s["chars"] + x["size"]).alias("chars"), F.concat(s["out"], F.array(F.struct(x["place"].alias("place"), now.alias("batch")))).alias("out"))

    per = items.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), F.col("size").cast("long").alias("size")))).alias("a"))
    return per.select("scope", F.explode(F.aggregate("a", start, step)["out"]).alias("x")).select("scope", "x.place", "x.batch")


def scorecard(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(pair, recall, false_positives, leaked, evidenced) of each pair: expectations and found changes match one to one by (kind,
    value), meaningful before noise. expected: pair, kind, value; found: pair, id, kind, value, noise, has_evidence."""
    by = ["pair", "kind", "value"]
    e = expected.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(1))))
    f = found.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("noise", "id")))
    j = e.withColumn("_e", F.lit(1)).join(f, [*by, "rn"], "full_outer")
    hit = F.col("_e").isNotNull() & F.col("id").isNotNull()
    n_expected, n_found = F.count("_e"), F.count("id")
    return j.groupBy("pair").agg(
        F.when(n_expected == 0, 1.0).otherwise(F.count_if(hit) / n_expected).alias("recall"), F.count_if(F.col("_e").isNull() & ~F.col("noise")).alias("false_positives"),
        F.count_if(hit & F.col("noise")).alias("leaked"), F.when(n_found == 0, 1.0).otherwise(F.count_if("has_evidence") / n_found).alias("evidenced"),
    )
