"""Pages of Word files from the page breaks stored in them, as a scan of a table of events, and whether those pages can be trusted.

Events (scope, pos, unit, kind, words, row, cell), in order of pos: `text` with its number of words, `object`, `hard` (a page break), `rendered` (where the program that saved
the file began a page) and `before` (a paragraph that starts a page). A rendered break that follows a hard one with no content between is the same break. `before` counts
only where there was content. Each cell of a table's row (row, cell; null outside of tables) starts from the page of its row; the row ends as the first of its cells that reaches
the furthest page, or as it began if no cell left that page.

Whether a rendered break counts hangs on one bit: was a hard break the last thing? Every event, and every row as a whole, maps that bit to a bit: text sets 0, a hard break 1, a
rendered break keeps it, a row may even swap it. So the bit at any place is that of the last event that sets it, turned over once for each swap since, and both are running windows.
The windows are of one document, the first of one cell; a document's events stay in one task and spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How far a stored count of words may be off, as a share of the words read and in words.
SHARE, SLACK = 0.15, 10


def _until(*keys: str):
    """Along pos: what comes before a row."""
    return Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)


def _bit(kind: Column, words: Column) -> Column:
    """What an event sets the bit to; null where it keeps it."""
    return F.when((kind == "object") | ((kind == "text") & (words > 0)), 0).when(kind == "hard", 1)


def _steps(kind: Column, bit: Column) -> Column:
    return F.when(kind == "hard", 1).when((kind == "rendered") & (bit == 0), 1).otherwise(0)


def _flags(steps: DataFrame) -> DataFrame:
    """steps (scope, pos, to0, to1) with bit: what it is before each step."""
    w = _until("scope")
    turned = steps.withColumn("turns", F.coalesce(F.sum(F.when((F.col("to0") == 1) & (F.col("to1") == 0), 1).otherwise(0)).over(w), F.lit(0)))
    last = F.last(F.when(F.col("to0") == F.col("to1"), F.struct(F.col("to0").alias("v"), "turns")), ignorenulls=True).over(w)
    return turned.withColumn("last", last).withColumn("bit", (F.coalesce("last.v", F.lit(0)) + F.col("turns") - F.coalesce("last.turns", F.lit(0))) % 2).drop("last", "turns")


def numbered(events: DataFrame) -> DataFrame:
    """The events with page (that an event begins on) and counts (whether it starts a page).

    Null words are 0, other kinds change nothing; `before` in a cell is ignored, as is the cell of an event without a row, while a row's null cell is one of its own. Rows without a scope or
    a pos are left out; of events with one pos any may come first. A row is one run of events: its number comes up once in a document.
    """
    e = events.select("scope", "pos", "unit", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("words", F.lit(0)).cast("int").alias("words"), "row", F.when(F.col("row").isNotNull(), F.coalesce(F.col("cell"), F.lit(-1))).alias("cell"))
    e = e.where("scope is not null and pos is not null").repartition("scope")
    kind, words = F.col("kind"), F.col("words")
    inside = F.col("row").isNotNull()

    w = _until("scope", "row", "cell")
    own = e.where(inside).withColumn("own", F.last(_bit(kind, words), ignorenulls=True).over(w))
    for a in (0, 1):
        own = own.withColumn(f"s{a}", _steps(kind, F.coalesce("own", F.lit(a)))).withColumn(f"in{a}", F.coalesce(F.sum(f"s{a}").over(w), F.lit(0)))
    bit = _bit(kind, words)
    cells = own.groupBy("scope", "row", "cell").agg(F.min("pos").alias("pos"), F.sum("s0").alias("d0"), F.sum("s1").alias("d1"), F.max_by(bit, F.when(bit.isNotNull(), F.col("pos"))).alias("end"), F.coalesce(F.max((bit == 0).cast("int")), F.lit(0)).alias("seen"))
    best = lambda a: F.max_by(F.struct(F.col(f"d{a}").alias("d"), "end", "seen"), F.struct(f"d{a}", -F.col("pos")))
    rows = cells.groupBy("scope", "row").agg(F.min("pos").alias("pos"), best(0).alias("b0"), best(1).alias("b1"))
    ends = lambda a: F.when(F.col(f"b{a}.d") > 0, F.coalesce(f"b{a}.end", F.lit(a))).otherwise(a)
    seen = lambda a: F.when(F.col(f"b{a}.d") > 0, F.col(f"b{a}.seen")).otherwise(0)
    rows = rows.select("scope", "pos", "row", F.lit(None).cast("string").alias("kind"), F.lit(0).alias("words"), F.lit(None).cast(e.schema["unit"].dataType).alias("unit"), F.col("b0.d").alias("d0"), F.col("b1.d").alias("d1"), ends(0).alias("to0"), ends(1).alias("to1"), seen(0).alias("seen0"), seen(1).alias("seen1"))

    content = (F.coalesce(bit, F.lit(-1)) == 0).cast("int")
    body = e.where(~inside).select("scope", "pos", "row", "kind", "words", "unit", _steps(kind, F.lit(0)).cast("long").alias("d0"), _steps(kind, F.lit(1)).cast("long").alias("d1"), F.coalesce(bit, F.lit(0)).alias("to0"), F.coalesce(bit, F.lit(1)).alias("to1"), content.alias("seen0"), content.alias("seen1"))
    # Up to the first content no `before` counts, and from there on all do: the first pass takes none of them and is right as far as it is asked.
    steps = _flags(body.unionByName(rows))
    before = (F.coalesce("kind", F.lit("")) == "before") & (F.coalesce(F.max(F.when(F.col("bit") == 1, F.col("seen1")).otherwise(F.col("seen0"))).over(_until("scope")), F.lit(0)) == 1)
    steps = steps.withColumn("starts", before).withColumns({c: F.when(F.col("starts"), 1).otherwise(F.col(c)) for c in ("d0", "d1", "to0", "to1")})
    steps = _flags(steps.drop("bit")).withColumn("d", F.when(F.col("bit") == 1, F.col("d1")).otherwise(F.col("d0")))
    steps = steps.withColumn("page", 1 + F.coalesce(F.sum("d").over(_until("scope")), F.lit(0)))

    outer = steps.where(F.col("kind").isNotNull()).select("scope", "pos", "unit", "kind", "words", F.col("row"), F.lit(None).cast(e.schema["cell"].dataType).alias("cell"), "page", (F.col("d") > 0).alias("counts"))
    begun = steps.where(F.col("kind").isNull()).select("scope", "row", F.col("page").alias("begins"), "bit")
    at = lambda c: F.when(F.col("bit") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    inner = own.join(begun, ["scope", "row"]).select("scope", "pos", "unit", "kind", "words", "row", "cell", (F.col("begins") + at("in")).alias("page"), (at("s") > 0).alias("counts"))
    return outer.unionByName(inner)


def units(numbered_events: DataFrame) -> DataFrame:
    """(scope, unit, page, breaks): the page of each unit's first word, and the numbers of words (from 0) with which further pages begin within it.

    Breaks before the first word move the whole unit, those after the last belong to what follows. Units without words, and events without a unit, have no row."""
    e = numbered_events.where("unit is not null").withColumn("at", F.coalesce(F.sum("words").over(_until("scope", "unit")), F.lit(0)))
    text, broken = (F.col("kind") == "text") & (F.col("words") > 0), F.col("kind").isin("hard", "rendered") & F.col("counts") & (F.col("at") > 0)
    u = e.groupBy("scope", "unit").agg(F.min_by("page", F.when(text, F.col("pos"))).alias("page"), F.sum("words").alias("words"), F.array_sort(F.collect_list(F.when(broken, F.col("at")))).alias("breaks"))
    return u.where("words > 0").select("scope", "unit", "page", F.expr("filter(breaks, x -> x < words)").alias("breaks"))


def extents(numbered_events: DataFrame) -> DataFrame:
    """(scope, words, pages) of each document: the words read, and the page that it ends on."""
    return numbered_events.groupBy("scope").agg(F.sum("words").alias("words"), F.max(F.col("page") + F.col("counts").cast("long")).alias("pages"))


def trusted(extent: DataFrame, statistics: DataFrame) -> DataFrame:
    """Each document's extent with status (recorded or unavailable) and reason: empty, no_statistics, statistics_out_of_date, pages_disagree, or null.

    statistics (scope, stored_pages, stored_words), one row for each scope. The pages are believed only where the file's own statistics agree: a count of words within 15 % or 10 words
    of those read, the greater of the two, and not 0, and the same number of pages."""
    pages, words, read = F.col("stored_pages"), F.col("stored_words"), F.col("words")
    allowed = F.greatest(F.lit(SLACK).cast("double"), F.bround(read * SHARE))
    why = F.when(read == 0, "empty").when(pages.isNull() | (pages < 1) | words.isNull(), "no_statistics").when((words == 0) | (F.abs(words - read) > allowed), "statistics_out_of_date").when(F.col("pages") != pages, "pages_disagree")
    both = extent.join(statistics.select("scope", "stored_pages", "stored_words"), "scope", "left").withColumn("reason", why)
    return both.select("scope", "words", "pages", F.when(F.col("reason").isNull(), "recorded").otherwise("unavailable").alias("status"), "reason")
