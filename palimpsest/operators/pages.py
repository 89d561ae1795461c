"""Pages: running heads, order-preserving matching, chains in order."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lineage
from ..functions import text
from . import pairing


def running_heads(lines: DataFrame, share: float = 0.6, band: float | None = None) -> DataFrame:
    """(scope, template, n_pages) of lines that recur on share of the pages (3 at least). lines: (scope, page, text).

    band: only lines in the uppermost or lowest part of so much of a page's height count; they have their place there in a column y from 0 to 1."""
    pages = lines.groupBy("scope").agg(F.count_distinct("page").alias("pages"))
    if band is not None:
        lines = lines.where((F.col("y") <= band) | (F.col("y") >= 1 - band))
    n = lines.select("scope", "page", text.template(F.col("text")).alias("template")).where("template <> ''").groupBy("scope", "template").agg(F.count_distinct("page").alias("n_pages"))
    return n.join(pages, "scope").where((F.col("pages") >= 3) & (F.col("n_pages") >= F.greatest(F.lit(3), F.floor(share * F.col("pages"))))).select("scope", "template", "n_pages")


def heaviest_chain(places: list[tuple[int, int, float]]) -> list[int]:
    """Indexes of pairs (i, j, score) that rise in both i and j and have the greatest sum of scores.

    In order of i, a frontier is kept of chains that end at different j, each heavier than all that end before it; a pair extends the heaviest
    chain that ends below its j. So the work grows with pairs times the logarithm of the frontier, not with all places of both sides.
    """
    ends: list[int] = []  # j of the frontier, ascending
    chains: list[tuple[float, int]] = []  # weight and last pair of each
    back: dict[int, int] = {}
    order = sorted(range(len(places)), key=lambda k: (places[k][0], -places[k][1], k))
    for k in order:
        _, j, score = places[k]
        at = bisect_left(ends, j)
        weight, back[k] = (chains[at - 1][0] + score, chains[at - 1][1]) if at else (score, -1)
        if at < len(ends) and ends[at] == j and chains[at][0] >= weight:
            continue
        stop = at
        while stop < len(ends) and chains[stop][0] <= weight:
            stop += 1
        ends[at:stop], chains[at:stop] = [j], [(weight, k)]
    out, k = [], chains[-1][1] if chains else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def matched_pages(old: DataFrame, new: DataFrame, words: Column, least: float = 0.35, moved: float = 0.8) -> DataFrame:
    """(scope, old_page, new_page, score, in_order) of pages that share words: best pairs one to one in order, then what is left, out of order.

    old, new: (scope, page, ...) with the column that words reads. All pairs of a Jaccard similarity of `least` or more compete. In order are the
    pairs of the heaviest chain; of the pages outside it, pairs of `moved` or more, best first, are moved pages.
    """
    scored = pairing.alike_sets(old, new, "scope", "page", words, least)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["old_page", "new_page"]).reset_index(drop=True)
        own = heaviest_chain(list(zip(pdf["old_page"].tolist(), pdf["new_page"].tolist(), pdf["score"].tolist(), strict=True)))
        pdf["in_order"] = False
        pdf.loc[own, "in_order"] = True
        used = pdf.loc[own]
        rest = pdf[~pdf["old_page"].isin(used["old_page"]) & ~pdf["new_page"].isin(used["new_page"]) & (pdf["score"] >= moved)]
        return pd.concat([used, rest])

    found = lineage.written(scored.groupBy("scope").applyInPandas(chain, T.StructType([*scored.schema.fields]).add("in_order", "boolean")))
    return found.where("in_order").union(pairing.one_to_one(found.where("not in_order"), ["scope"], "old_page", "new_page", [-F.col("score")]))


def page_links(old: DataFrame, new: DataFrame, pairs: DataFrame) -> DataFrame:
    """(scope, old_page, new_page, kind, comparable) of every page: matched, moved, removed or added.

    old, new: (scope, page, has_text), pages numbered from 1 without gaps; pairs: (scope, old_page, new_page, in_order) by content. Pages
    without text then follow their matched neighbours, if the page they lead to has no text either and is free: the pages after a matched one in
    turn, the last of a run only if the next match agrees, or by the next match alone. What is left pairs in order of pages; only the surplus of a
    side is removed or added. comparable: both pages have text.
    """
    place = Window.partitionBy("scope").orderBy("page")
    known = pairs.select("scope", F.col("old_page").alias("page"), F.col("new_page").alias("to"), "in_order")
    left = old.select("scope", "page", "has_text").join(known, ["scope", "page"], "left")
    free = new.select("scope", "page", "has_text").join(pairs.select("scope", F.col("new_page").alias("page")), ["scope", "page"], "left_anti")
    bare = F.col("to").isNull() & ~F.col("has_text")
    fixed = F.when(~bare, F.struct("page", "to"))
    near = left.withColumns({"bare": bare, "before": F.last(fixed, True).over(place), "after": F.first(fixed, True).over(place.rowsBetween(1, Window.unboundedFollowing))}).where("bare")
    ahead, last = F.col("before.to") + F.col("page") - F.col("before.page"), F.col("after.page") == F.col("page") + 1
    ends = F.when(last, F.col("after.to"))
    to = F.when(F.col("before.to").isNull(), ends - 1).when(ends.isNull() | (ends == ahead + 1), ahead)
    run = Window.partitionBy("scope", "before.page").orderBy("page")
    led = near.withColumn("to", to).join(free.where("not has_text").select("scope", F.col("page").alias("to"), F.lit(1).alias("ok")), ["scope", "to"], "left")
    led = led.withColumn("ok", F.when(F.col("before.to").isNull(), F.col("ok")).otherwise(F.min(F.coalesce("ok", F.lit(0))).over(run))).where("ok = 1")
    led = led.withColumn("rn", F.row_number().over(Window.partitionBy("scope", "to").orderBy("page"))).where("rn = 1").select("scope", F.col("page").alias("old_page"), F.col("to").alias("new_page"))
    found = pairs.select("scope", "old_page", "new_page", "in_order").unionByName(led.withColumn("in_order", F.lit(True)))
    rest = lambda df, p: df.select("scope", F.col("page").alias(p)).join(found.select("scope", p), ["scope", p], "left_anti").withColumn("rn", F.row_number().over(Window.partitionBy("scope").orderBy(p)))
    remaining = rest(old, "old_page").join(rest(new, "new_page"), ["scope", "rn"], "full_outer").select("scope", "old_page", "new_page", F.lit(True).alias("in_order"))
    text_of = lambda df, p: df.select("scope", F.col("page").alias(p), F.col("has_text").alias(f"{p}_text"))
    every = found.unionByName(remaining).join(text_of(old, "old_page"), ["scope", "old_page"], "left").join(text_of(new, "new_page"), ["scope", "new_page"], "left")
    kind = F.when(F.col("new_page").isNull(), "removed").when(F.col("old_page").isNull(), "added").when(F.col("in_order"), "matched").otherwise("moved")
    return every.select("scope", "old_page", "new_page", kind.alias("kind"), F.coalesce(F.col("old_page_text") & F.col("new_page_text"), F.lit(False)).alias("comparable"))


def longest_chain(order: list[int]) -> set[int]:
    """Indexes of a longest increasing chain; what lies outside has moved."""
    tails, at, back = [], [], []
    for k, x in enumerate(order):
        p = bisect_left(tails, x)
        if p == len(tails):
            tails.append(x)
            at.append(k)
        else:
            tails[p], at[p] = x, k
        back.append(at[p - 1] if p else -1)
    out, k = set(), at[-1] if at else -1
    while k >= 0:
        out.add(k)
        k = back[k]
    return out
