"""Queries that compare `pages` with an edited second version."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff, regions, web
from ..sources import html
from .registry import query, table


def versions(spark, sf_dir):
    """The pages, and a version in which titles, languages, addresses and, in every fourth page, the first paragraph have changed."""
    old = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    k, h = F.col("page_id"), F.col("html")
    new = F.when(k % 3 == 0, F.replace(h, F.lit("<title>"), F.lit("<title>New "))).when(k % 3 == 1, F.regexp_replace(h, r'<html lang="[^"]*"', "<html")).otherwise(F.replace(h, F.lit("</head>"), F.lit('<meta name="description" content="about it"></head>')))
    return old, old.select("page_id", F.when(k % 7 == 0, F.concat(F.col("url"), F.lit("#x"))).otherwise(F.col("url")).alias("url"), F.when(k % 4 == 0, F.replace(new, F.lit("</article>"), F.lit("<p>One more paragraph.</p></article>"))).otherwise(new).alias("html"))


@query("""WITH t AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<html[^>]*lang="([^"]*)"', 1) AS lang FROM pages)
SELECT page_id, 'title' AS label, CASE WHEN trim(title) = '' THEN 'added' ELSE 'modified' END AS kind FROM t WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'lang', 'removed' FROM t WHERE page_id % 3 = 1 AND lang <> '' UNION ALL SELECT page_id, 'description', 'added' FROM t WHERE page_id % 3 = 2
UNION ALL SELECT page_id, 'address', 'modified' FROM pages WHERE page_id % 7 = 0""")
def metadata_changes(spark, sf_dir):
    return web.metadata_changes(*versions(spark, sf_dir)).select("page_id", "label", "kind")


@query("""WITH t AS (SELECT page_id, regexp_extract(html, '(?is)<html[^>]*lang="([^"]*)"', 1) AS lang FROM pages), c AS (
SELECT page_id, 'metadata' AS layer FROM t WHERE page_id % 3 <> 1 OR lang <> '' UNION ALL SELECT page_id, 'metadata' FROM pages WHERE page_id % 7 = 0
UNION ALL SELECT page_id, 'block' FROM pages WHERE page_id % 4 = 0 AND contains(html, '</article>'))
SELECT page_id, layer, count(*) AS n FROM c GROUP BY ALL""")
def web_changes(spark, sf_dir):
    """Changes of all layers by page; the edits touch metadata and blocks of text only."""
    return web.compare(*versions(spark, sf_dir)).groupBy("page_id", "layer").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT l_orderkey AS tbl, l_linenumber AS row, CASE WHEN l_orderkey % 5 = 0 AND l_linenumber > 2 THEN NULL ELSE l_partkey::VARCHAR END AS k FROM lineitem),
n AS (SELECT tbl, row + 1 AS row, k FROM o WHERE (tbl + row) % 4 <> 0),
m AS (SELECT tbl, coalesce(bool_and(a.ok), false) AND coalesce(bool_and(b.ok), false) AS by_key FROM (SELECT tbl, count(*) = count(DISTINCT k) AS ok FROM o GROUP BY tbl) a FULL JOIN (SELECT tbl, count(*) = count(DISTINCT k) AS ok FROM n GROUP BY tbl) b USING (tbl) GROUP BY tbl),
p AS (SELECT tbl, row, CASE WHEN by_key THEN 'k:' || k ELSE '#' || row END AS pair FROM o JOIN m USING (tbl)), q AS (SELECT tbl, row, CASE WHEN by_key THEN 'k:' || k ELSE '#' || row END AS pair FROM n JOIN m USING (tbl))
SELECT tbl, coalesce(p.row, -1)::BIGINT AS old_place, coalesce(q.row, -1)::BIGINT AS new_place FROM p FULL JOIN q USING (tbl, pair)""")
def paired_rows(spark, sf_dir):
    """Lines of each order, paired by part where that names a line on both sides, else by number."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    old = table(spark, sf_dir, "lineitem").select(o.alias("tbl"), n.cast("long").alias("row"), F.when((o % 5 == 0) & (n > 2), None).otherwise(F.col("l_partkey").cast("string")).alias("k"))
    new = old.where("(tbl + row) % 4 <> 0").withColumn("row", F.col("row") + 1)
    found = diff.keyed_or_positional(old, new, "tbl", "k", "row")
    return found.select("tbl", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("old_place", "new_place")))


def edited_pages(spark, sf_dir):
    """The pages with a sentence, a table and a link more, and a version in which these are edited by the page's number."""
    own = table(spark, sf_dir, "pages").where("page_id is not null").select("page_id", "url", "html")
    k, lit = F.col("page_id"), F.lit
    s = lambda c: c.cast("string")
    day = lambda more: F.date_format(F.date_add(lit("2024-01-01").cast("date"), (k % 700 + more).cast("int")), "d MMMM yyyy")
    row = lambda *cells: F.concat(lit("<tr>"), *(x for c in cells for x in (lit("<td>"), c if not isinstance(c, str) else lit(c))))
    head = lambda *names: lit("<tr>" + "".join(f"<th>{n}" for n in names))
    said = lambda d: F.concat(lit("<p>The offer for all who read this stands until "), d, lit(" and no longer.</p>"))
    fee = F.concat(lit("$"), s(10 + k % 90))
    link = lambda words, v: F.concat(lit('<p><a href="https://g.example/'), s(k), lit(f"?v={v}"), lit('">'), lit(words), s(k), lit(" today</a></p>"))
    old = F.concat(said(day(0)), lit("<table>"), head("Plan", "Fee", "Seats"), row("Basic", fee, "3"), row("Pro", "$90", "9"), lit("</table>"), link("Read guide ", 1))
    later = F.when(k % 4 == 0, 0).when(k % 4 == 1, 5).when(k % 4 == 2, 40).otherwise(400)
    new_fee = F.when(k % 3 == 0, F.concat(lit("$"), s(15 + k % 90))).otherwise(fee)
    rows = (
        F.when(k % 5 == 0, F.concat(head("Plan", "Fee", "Seats"), row("Basic", new_fee, "3"))).when(k % 5 == 1, F.concat(head("Plan", "Fee", "Seats"), row("Max", "$200", "20"), row("Basic", new_fee, "3"), row("Pro", "$90", "9")))
        .when(k % 5 == 2, F.concat(head("Plan", "Seats", "Fee"), row("Basic", "3", new_fee), row("Pro", "9", "$90"))).when(k % 5 == 3, F.concat(head("Plan", "Fee", "Users"), row("Basic", new_fee, "3"), row("Pro", "$90", "9")))
        .otherwise(F.concat(head("Plan", "Fee", "Seats"), row("Basic", new_fee, "3"), row("Pro", "$95", "9")))
    )
    links = F.when(k % 7 == 0, link("Read the guide ", 2)).when(k % 7 == 1, link("Read guide ", 2)).when(k % 7 == 2, F.concat(lit("<p>Read guide "), s(k), lit(" today</p>"))).otherwise(link("Read guide ", 1))
    new = F.concat(said(day(later)), lit("<table>"), rows, lit("</table>"), links)
    with_it = lambda more: own.select("page_id", "url", F.concat(F.col("html"), lit("</article>"), more).alias("html"))
    return with_it(old), with_it(new)


@query("""WITH t AS (SELECT page_id AS k, DATE '2024-01-01' + (page_id % 700)::INT AS d, [0, 5, 40, 400][1 + page_id % 4]::INT AS later, 10 + page_id % 90 AS fee FROM pages WHERE page_id IS NOT NULL),
c AS (SELECT k, 'block' AS layer, 'modified' AS kind, 'date' AS category, NULL AS label, strftime(d, '%-d %B %Y') AS old_value, strftime(d + later, '%-d %B %Y') AS new_value, later || ' days later' AS difference FROM t WHERE later > 0
UNION ALL SELECT k, 'block', 'added', 'text', NULL, NULL, 'the', NULL FROM t WHERE k % 7 = 0
UNION ALL SELECT k, 'table', 'modified', 'number', 'Basic · Fee', '$' || fee, '$' || (fee + 5), '+5 (+' || regexp_replace(round(500.0 / fee, 2)::DECIMAL(18,2)::VARCHAR, '\\.?0+$', '') || '%)' FROM t WHERE k % 3 = 0
UNION ALL SELECT k, 'table', 'removed', 'table', 'Pro', 'Pro · $90 · 9', NULL, NULL FROM t WHERE k % 5 = 0
UNION ALL SELECT k, 'table', 'added', 'table', 'Max', NULL, 'Max · $200 · 20', NULL FROM t WHERE k % 5 = 1
UNION ALL SELECT k, 'table', 'modified', 'table', 'Plan', 'Seats', 'Users', NULL FROM t WHERE k % 5 = 3
UNION ALL SELECT k, 'table', 'modified', 'number', 'Pro · Fee', '$90', '$95', '+5 (+5.56%)' FROM t WHERE k % 5 = 4
UNION ALL SELECT k, 'link', 'modified', 'link', CASE k % 7 WHEN 0 THEN 'Read the guide ' ELSE 'Read guide ' END || k || ' today', 'https://g.example/' || k || '?v=1', 'https://g.example/' || k || '?v=2', NULL FROM t WHERE k % 7 < 2
UNION ALL SELECT k, 'link', 'removed', 'link', 'Read guide ' || k || ' today', 'https://g.example/' || k || '?v=1', NULL, NULL FROM t WHERE k % 7 = 2)
SELECT k AS page_id, layer, kind, category, label, old_value, new_value, difference FROM c""")
def web_edits(spark, sf_dir):
    """All changes of edited pages: dates, rows, columns, cells, links and their words. Labels of blocks, which are headings of the page, are left out."""
    found = web.compare(*edited_pages(spark, sf_dir))
    return found.select("page_id", "layer", "kind", "category", F.when(F.col("layer") != "block", F.col("label")).alias("label"), "old_value", "new_value", "difference")


#: The parts of a page's address that a made page holds: u, all of it, v, its host.
MADE = """m AS (SELECT page_id, length(url) AS u, length(split_part(url, '/', 3)) AS v FROM pages WHERE page_id IS NOT NULL AND url NOT LIKE '% %'),
e AS (SELECT page_id, 'body' AS tag, 'page' AS id, u + 1 + u + v + 3 + u AS n, u + u AS l, 1 AS p FROM m UNION ALL SELECT page_id, 'nav', 'top', u, u, 0 FROM m UNION ALL SELECT page_id, 'div', 'text', u + v + 3, 0, 1 FROM m
UNION ALL SELECT page_id, 'div', 'links', u + 0, u + 0, 0 FROM m UNION ALL SELECT page_id, 'div', 'none', 0, 0, 0 FROM m)"""


def made_pages(spark, sf_dir):
    """A page for each of `pages`: its address as a link, in a paragraph with its host, and as a link that goes on within a word."""
    own = table(spark, sf_dir, "pages").where("page_id is not null and url not like '% %'")
    u, v, lit = F.col("url"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit
    parts = [lit('<html><head><title>no</title></head><body id="page"><nav id="top"><a href="/">'), u, lit('</a></nav>\n<div id="text"><script>var no</script><p>'), u, lit(" <b>a</b>b"), v, lit('</p></div><div id="links"><a>'), u, lit('</a></div><div id="none"> <br></div><div hidden>no</div></body></html>')]
    return own.select("page_id", F.concat(*parts).alias("html"))


@query(f"""WITH {MADE} SELECT page_id, id, tag, n::BIGINT AS text_length, l::BIGINT AS link_length, p::BIGINT AS paragraphs, round(CASE WHEN n = 0 THEN 0 ELSE n * (1 - least(l / n, 1.0)) + 40.0 * p END, 6) AS score FROM e""")
def region_scores(spark, sf_dir):
    """The score of each named element of made pages."""
    found = regions.scores(html.elements(made_pages(spark, sf_dir)))
    return found.where("id <> ''").select("page_id", "id", "tag", "text_length", "link_length", "paragraphs", F.round("score", 6).alias("score"))


@query(f"""WITH {MADE}, s AS (SELECT page_id, v + 3 + 40 + u AS best, (u + 1 + u + v + 3 + u) - (u + u) + 40 AS whole FROM m)
SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'main' ELSE 'article' END AS tag, CASE WHEN page_id % 3 = 1 THEN 'main_element' ELSE 'article_element' END AS strategy FROM pages WHERE page_id % 3 < 2
UNION ALL SELECT page_id, CASE WHEN best >= 0.6 * whole THEN 'div' ELSE 'body' END, CASE WHEN best >= 0.6 * whole THEN 'scored_region' ELSE 'body_fallback' END FROM s WHERE page_id % 3 = 2""")
def main_regions(spark, sf_dir):
    """Where the content of each page is: of every third page in its article, of every third, where that is named main, there, of the others, which are made pages, by score."""
    own = table(spark, sf_dir, "pages").where("page_id % 3 < 2")
    own = own.select("page_id", F.when(F.col("page_id") % 3 == 1, F.replace(F.replace("html", F.lit("<article"), F.lit("<main")), F.lit("</article>"), F.lit("</main>"))).otherwise(F.col("html")).alias("html"))
    return regions.main_region(regions.scores(html.elements(own.union(made_pages(spark, sf_dir).where("page_id % 3 = 2"))))).select("page_id", "tag", "strategy")
