"""Where the content of a web page is: scores of all its elements, the region chosen, furniture in it.

Elements are rows (page_id, node, last, depth, tag, role, class, id, signs, starts, inside), numbered in reading order, so an element and all in it are the nodes from node to last. What an
element holds is a difference of two running sums: one window over a page, and a join on the number of the last node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Containers that may be a region without <main> or <article>, what a paragraph is worth, least share of the page's score, part of the best score that
# counts as best, and share of the region's text from which furniture is taken for content.
SCORABLE, PARAGRAPH, LEAST_SHARE, AS_GOOD, CONTENT = ("div", "section", "td", "table"), 40.0, 0.6, 0.999, 0.4
CHROME_TAGS, CHROME_ROLES = ("nav", "header", "footer", "aside"), ("navigation", "banner", "contentinfo", "complementary", "search")


def _within(nodes: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """nodes with the sum of each value over an element and all in it."""
    order = Window.partitionBy("page_id").orderBy("node")
    run = nodes.withColumns({f"_own_{n}": c for n, c in sums.items()})
    run = run.withColumns({f"_upto_{n}": F.sum(f"_own_{n}").over(order) for n in sums})
    ends = run.select("page_id", F.col("node").alias("last"), *(F.col(f"_upto_{n}").alias(f"_end_{n}") for n in sums))
    both = run.join(ends, ["page_id", "last"])
    return both.select(*nodes.columns, *((F.col(f"_end_{n}") - F.col(f"_upto_{n}") + F.col(f"_own_{n}")).alias(n) for n in sums))


def scores(elements: DataFrame) -> DataFrame:
    """elements, without texts, with text_length (signs of its text, words one space apart), link_length (of the links in it), paragraphs and score.

    The score is the text that isn't link, and PARAGRAPH for each paragraph; 0 without text. A page without elements has no rows.
    """
    held = _within(elements, {"_signs": F.col("signs"), "_starts": F.col("starts"), "_p": (F.col("tag") == "p").cast("long")})
    words = F.col("_starts") + F.col("inside").cast("long")  # an element begins with a word, also if that began before it
    sized = held.withColumn("text_length", F.when(F.col("_signs") > 0, F.col("_signs") + words - 1).otherwise(0)).withColumn("paragraphs", F.col("_p"))
    linked = _within(sized.drop("_signs", "_starts", "_p"), {"link_length": F.when(F.col("tag") == "a", F.col("text_length")).otherwise(0).cast("long")})
    share = F.least(F.col("link_length") / F.col("text_length"), F.lit(1.0))
    score = F.when(F.col("text_length") > 0, F.col("text_length") * (1 - share) + F.col("paragraphs") * PARAGRAPH).otherwise(0.0)
    return linked.where("tag <> '#text'").withColumn("score", score).drop("signs", "starts", "inside")


def main_region(scored: DataFrame) -> DataFrame:
    """(page_id, node, last, tag, text_length, score, strategy): one row for each page.

    The first <main>, or element of that role; else the article of the highest score; else, if its score is LEAST_SHARE of the body's, the deepest of the containers that score about
    as well as the best; else the body. Ties go to the element that comes first.
    """
    page = Window.partitionBy("page_id")
    d = scored.withColumns({
        "_best": F.max(F.when(F.col("tag").isin(*SCORABLE), F.col("score"))).over(page),
        "_body": F.coalesce(F.max(F.when(F.col("tag") == "body", F.col("score"))).over(page), F.max(F.when(F.col("node") == 0, F.col("score"))).over(page)),
        "_has_body": F.bool_or(F.col("tag") == "body").over(page),
    })
    main = (F.col("tag") == "main") | (F.col("role") == "main")
    region = F.col("tag").isin(*SCORABLE) & (F.col("score") > 0) & (F.col("_best") >= F.col("_body") * LEAST_SHARE) & (F.col("score") >= F.col("_best") * AS_GOOD)
    body = F.when(F.col("_has_body"), F.col("tag") == "body").otherwise(F.col("node") == 0)
    kind = F.when(main, 0).when(F.col("tag") == "article", 1).when(region, 2).when(body, 3)
    first = F.row_number().over(page.orderBy("_kind", F.when(F.col("_kind") == 1, -F.col("score")), F.when(F.col("_kind") == 2, -F.col("depth")), "node"))
    names = F.element_at(F.array(*(F.lit(x) for x in ("main_element", "article_element", "scored_region", "body_fallback"))), F.col("_kind") + 1)
    return d.withColumn("_kind", kind).where("_kind is not null").withColumn("_nth", first).where("_nth = 1").select("page_id", "node", "last", "tag", "text_length", "score", names.alias("strategy"))


def furniture(scored: DataFrame, region: DataFrame, noise: list[str] | None = None) -> DataFrame:
    """(page_id, node, last, reason, kept): elements within each page's region that are navigation by tag, by role or by a word of their class or id. kept: it holds so much of
    the region's text that it is content. Elements within furniture that goes are not named again."""
    of = region.select("page_id", F.col("node").alias("_node"), F.col("last").alias("_last"), F.greatest(F.col("text_length"), F.lit(1)).alias("_whole"))
    token = text.first_token(F.concat_ws(" ", "class", "id"), noise) if noise else F.lit(None).cast("string")
    reason = F.when(F.col("tag").isin(*CHROME_TAGS), F.col("tag")).when(F.col("role").isin(*CHROME_ROLES), F.concat(F.lit("role="), F.col("role"))).otherwise(F.concat(F.lit("noise:"), token))
    found = scored.join(of, "page_id").where((F.col("node") > F.col("_node")) & (F.col("node") <= F.col("_last"))).withColumn("reason", reason).where("reason is not null")
    found = found.withColumn("kept", F.col("text_length") / F.col("_whole") >= CONTENT)
    gone = F.max(F.when(~F.col("kept"), F.col("last"))).over(Window.partitionBy("page_id").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_gone", gone).where("_gone is null or node > _gone").select("page_id", "node", "last", "reason", "kept")
