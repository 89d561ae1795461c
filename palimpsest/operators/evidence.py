"""Evidence and constraints: what a feed claims is looked up in its sources; violations are rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as text_functions


def verify(evidence: DataFrame, units: DataFrame) -> DataFrame:
    """evidence (change_id, side, unit_id, excerpt) with issue: unknown_unit, no_excerpt, not_quoted or null. units: (side, unit_id, text)."""
    both = evidence.join(units, ["side", "unit_id"], "left")
    return both.withColumn("issue", F.when(F.col("text").isNull(), "unknown_unit").when(F.coalesce(F.trim("excerpt"), F.lit("")) == "", "no_excerpt").when(~F.col("text").contains(F.col("excerpt")) & ~F.col("excerpt").contains(F.col("text")), "not_quoted")).drop("text")


def verify_cells(evidence: DataFrame, cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """evidence (change_id, side, sheet, ref, fingerprint, excerpt) with issue: other_document, unknown_sheet, empty_cell, not_quoted or null.

    cells: (side, sheet, ref, text); sheets: (side, sheet, fingerprint of its workbook). A quote is a cell's whole text, or its beginning and "…".
    """
    both = evidence.join(sheets.select("side", "sheet", F.col("fingerprint").alias("_of")), ["side", "sheet"], "left").join(cells.select("side", "sheet", "ref", F.col("text").alias("_text")), ["side", "sheet", "ref"], "left")
    quote, shown = F.col("excerpt"), F.col("_text")
    begins = quote.endswith("…") & shown.startswith(F.regexp_replace(quote, "…$", "")) & (F.length(quote) > 1)
    issue = (
        F.when(F.col("_of").isNull(), "unknown_sheet").when(~F.col("fingerprint").eqNullSafe(F.col("_of")), "other_document")
        .when(F.coalesce(F.trim(shown), F.lit("")) == "", "empty_cell").when(~F.coalesce((quote == shown) | begins, F.lit(False)), "not_quoted")
    )
    return both.withColumn("issue", issue).drop("_of", "_text")


def traceable(feed: DataFrame, checked: DataFrame) -> DataFrame:
    """The changes of which every piece of evidence was found, and that have some."""
    bad = checked.where("issue is not null").select("change_id")
    return feed.join(bad, "change_id", "left_anti").join(checked.select("change_id"), "change_id", "left_semi")


def violations(feed: DataFrame, evidence: DataFrame) -> DataFrame:
    """(change_id, rule): sides that don't fit the kind, missing values, repeated ids, annotations of nothing."""
    sides = evidence.groupBy("change_id").agg(F.max((F.col("side") == "old").cast("int")).alias("o"), F.max((F.col("side") == "new").cast("int")).alias("n"))
    f = feed.join(sides, "change_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in "on"})
    wrong = F.when(F.col("kind") == "added", (F.col("n") == 0) | (F.col("o") == 1)).when(F.col("kind") == "removed", (F.col("o") == 0) | (F.col("n") == 1)).otherwise((F.col("o") == 0) | (F.col("n") == 0))
    parts = [
        f.where(wrong).select("change_id", F.lit("sides").alias("rule")),
        f.where((F.col("kind") == "modified") & (F.col("old_value").isNull() | F.col("new_value").isNull())).select("change_id", F.lit("values").alias("rule")),
        feed.groupBy("change_id").agg(F.count("*").alias("n")).where("n > 1").select("change_id", F.lit("repeated_id").alias("rule")),
        evidence.join(feed, "change_id", "left_anti").select("change_id", F.lit("unknown_change").alias("rule")).distinct(),
    ]
    return reduce(DataFrame.union, parts)


def ratchet(before: DataFrame, now: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, metric, verdict): pairs that are missing, new, worse, better or same."""
    long = lambda df, v: df.select(key, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(key, metrics, "metric", v)
    both = long(before, "was").join(long(now, "now"), [key, "metric"], "full_outer")
    verdict = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("now") < F.col("was"), "worse").when(F.col("now") > F.col("was"), "better").otherwise("same")
    return both.select(key, "metric", verdict.alias("verdict"))


def page_issues(evidence: DataFrame, documents: DataFrame, pages: DataFrame, words: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(scope, change_id, nth, issue, word): what keeps evidence on pages from being traced, a row for each issue; evidence without issues has none.

    other_document: the evidence has another fingerprint than its side's document, or there is none. no_page: the document has no such page; nothing else is then asked. no_word, with the word: it isn't
    on that page. box_outside: the box reaches over the page by more than tolerance. not_quoted: neither the words that were found, in the order in which they are cited, nor the excerpt hold the
    other; without words or excerpt nothing is quoted.
    evidence: (scope, change_id, nth, side, fingerprint, page, words: array of names, box: struct x0 y0 x1 y1, excerpt); documents: (scope, side, fingerprint); pages: (scope, side, page, width, height);
    words: (scope, side, page, word, text). Nulls among words are left out. The words of a page are one row, which evidence meets; neither cited words nor issues are shuffled.
    """
    key = ["scope", "change_id", "nth"]
    listed = words.where("word is not null").groupBy("scope", "side", "page").agg(F.collect_list(F.struct("word", "text")).alias("_words"))
    paged = pages.select("scope", "side", "page", "width", "height").join(listed, ["scope", "side", "page"], "left")
    of = evidence.join(documents.select("scope", "side", F.col("fingerprint").alias("_of")), ["scope", "side"], "left").join(paged, ["scope", "side", "page"], "left")
    there = F.col("width").isNotNull()
    known = F.coalesce("_words", F.array().cast(listed.schema["_words"].dataType))
    named = F.filter("words", lambda w: w.isNotNull())
    texts = F.transform(named, lambda w: F.struct(w.alias("word"), F.transform(F.filter(known, lambda x: x["word"] == w), lambda x: x["text"]).alias("texts")))
    of = of.withColumn("_found", F.when(there, texts))
    quoted = F.array_join(F.flatten(F.transform("_found", lambda x: F.array_sort(F.filter(x["texts"], lambda t: t.isNotNull())))), " ")
    lost = F.flatten(F.transform("_found", lambda x: F.transform(F.when(F.size(x["texts"]) == 0, F.array(F.lit(None).cast("string"))).otherwise(F.filter(x["texts"], lambda t: t.isNull())), lambda _: x["word"])))
    plain = lambda c: text_functions.normalize(c)
    of = of.withColumns({"_said": plain(F.coalesce("excerpt", F.lit(""))), "_shown": plain(F.coalesce(quoted, F.lit(""))), "_lost": F.coalesce(lost, F.array().cast("array<string>"))})
    said, shown = F.col("_said"), F.col("_shown")
    wide = F.greatest(-F.least("box.x0", "box.y0"), F.col("box.x1") - F.col("width"), F.col("box.y1") - F.col("height")) > tolerance
    other = ~F.col("fingerprint").eqNullSafe(F.col("_of"))
    mismatch = (said != "") & (shown != "") & ~said.contains(shown) & ~shown.contains(said)
    names = F.array_compact(F.array(F.when(other, F.lit("other_document")), F.when(~there, F.lit("no_page")), F.when(there & F.coalesce(wide, F.lit(False)), F.lit("box_outside")), F.when(there & mismatch, F.lit("not_quoted"))))
    issue = lambda name, word: F.struct(name.alias("issue"), word.alias("word"))
    every = F.concat(F.transform(names, lambda n: issue(n, F.lit(None).cast("string"))), F.transform("_lost", lambda w: issue(F.lit("no_word"), w)))
    return of.select(*key, F.explode(every).alias("_i")).select(*key, "_i.issue", "_i.word")
