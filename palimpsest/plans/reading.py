"""Queries of values and quotes, pages followed through both sides, evidence in cells, places in a report, and checked explanations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, urls, values
from ..operators import evidence, explain, pages, report
from ..sources import html
from .registry import query, table

CHROME = ["box", "promo", "economybox"]


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderdate::DATE::VARCHAR END AS day FROM orders""")
def whole_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.date_format("o_orderdate", "d MMMM yyyy").alias("named"))
    k = F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.concat(F.lit("("), "iso", F.lit(").”"))).when(k == 1, F.concat(F.lit(" "), "named", F.lit(","))).when(k == 2, F.col("iso")).otherwise(F.concat(F.lit("30 years until "), "named"))
    return o.select("o_orderkey", values.whole_date(shown).cast("string").alias("day"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT AS q, (l_partkey % 5)::INT AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, q, CASE k WHEN 0 THEN '+10 (+' || regexp_replace(round(1000 / q, 2)::DECIMAL(18,2)::VARCHAR, '\\.?0+$', '') || '%)' WHEN 1 THEN NULL WHEN 2 THEN '+10' WHEN 3 THEN '-' || q ELSE q || ' days later' END AS difference FROM t""")
def value_differences(spark, sf_dir):
    """Amounts of one currency, of two, percents, years, and dates, each made of a line's quantity."""
    q, k = F.col("l_quantity").cast("long"), F.col("l_partkey") % 5
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", q.alias("q"), k.alias("k"))
    q, k, s = F.col("q"), F.col("k"), F.col("q").cast("string")
    more = (q + 10).cast("string")
    day = F.lit("2024-01-01").cast("date")
    old = F.when(k == 0, F.concat(F.lit("$"), s)).when(k == 1, F.concat(F.lit("$"), s)).when(k == 2, F.concat(s, F.lit("%"))).when(k == 3, (q + 1900).cast("string")).otherwise(F.lit("1 January 2024"))
    new = F.when(k == 0, F.concat(F.lit("$"), more)).when(k == 1, F.concat(F.lit("€"), more)).when(k == 2, F.concat(more, F.lit("%"))).when(k == 3, F.lit("1900")).otherwise(F.date_add(day, q.cast("int")).cast("string"))
    shown = t.withColumns({"old": old, "new": new})  # columns, for values are read many times
    both = shown.withColumns({"old": values.typed(F.col("old")), "new": values.typed(F.col("new"))})
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "q", values.value_delta(F.col("old"), F.col("new")).alias("difference"))


@query(r"""SELECT p_partkey, trim(replace(regexp_replace(replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '' END || chr(10)), '([A-Za-z0-9_])-\n([a-z])', '\1\2', 'g'), chr(10), ' ')) AS shown FROM part""")
def rejoined_lines(spark, sf_dir):
    words = F.split("p_name", " ")
    last = F.size(words) - 1
    lines = F.transform(words, lambda w, i: F.when((F.col("p_partkey") % 2 == 0) & (i < last), F.concat(w, F.lit("-"))).otherwise(w))
    return table(spark, sf_dir, "part").select("p_partkey", text.rejoined(lines).alias("shown"))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '')[1:60] AS words FROM documents), t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
s AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS upto FROM t), q AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS quote, count(*)::INT AS n_tokens FROM s WHERE upto <= 240 GROUP BY doc_id)
SELECT doc_id, coalesce(quote, '') AS quote, coalesce(n_tokens, 0) AS n_tokens FROM documents LEFT JOIN q USING (doc_id)""")
def cited_words(spark, sf_dir):
    """What of a text is quoted as its evidence: the quote's length is the feature."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\n]+"), lambda w: w != "")
    return table(spark, sf_dir, "documents").select("doc_id", text.cited(words).alias("c")).select("doc_id", F.col("c.text").alias("quote"), "c.n_tokens")


@query(r"""WITH a AS (SELECT p_partkey, p_brand || ' ' || lower(p_type) || CASE WHEN p_partkey % 3 = 0 THEN 'Box' ELSE '-promo' END AS a FROM part),
t AS (SELECT p_partkey, list_distinct(list_concat(string_split_regex(lower(regexp_replace(a, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), list_transform(string_split(lower(a), ' '), lambda x: regexp_replace(x, '[^a-z0-9]+', '', 'g')))) AS t FROM a)
SELECT p_partkey, list_aggregate(list_sort(list_filter(t, lambda x: x <> '')), 'string_agg', ',') AS tokens, list_min(list_filter(t, lambda x: x IN ('box', 'promo', 'economybox'))) AS first FROM t""")
def attribute_words(spark, sf_dir):
    a = F.concat("p_brand", F.lit(" "), F.lower("p_type"), F.when(F.col("p_partkey") % 3 == 0, "Box").otherwise("-promo"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(text.attribute_tokens(a)), ",").alias("tokens"), text.first_token(a, CHROME).alias("first"))


@query("""WITH p AS (SELECT o_custkey AS scope, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey % 3 = 0 AS fixed FROM orders),
a AS (SELECT scope, page FROM p WHERE NOT fixed), b AS (SELECT scope, page FROM p WHERE NOT fixed AND NOT (scope % 2 = 0 AND page = 1) UNION ALL SELECT scope, max(page) + 1 FROM p GROUP BY scope),
i AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY page) AS rn FROM a), j AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY page) AS rn FROM b),
c AS (SELECT scope, coalesce(i.page, 0) AS old_page, coalesce(j.page, 0) AS new_page FROM i FULL JOIN j USING (scope, rn) UNION ALL SELECT scope, page, page FROM p WHERE fixed)
SELECT scope, old_page, new_page, CASE WHEN new_page = 0 THEN 'removed' WHEN old_page = 0 THEN 'added' ELSE 'matched' END AS kind, old_page > 0 AND new_page > 0 AS comparable FROM c""")
def linked_pages(spark, sf_dir):
    """Orders of a customer as pages with text, every third known to match; the other side lacks the first page of some and has one more."""
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    old = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), rn.alias("page"), (F.col("o_orderkey") % 3 == 0).alias("fixed"), F.lit(True).alias("has_text"))
    new = old.where("fixed or not (scope % 2 = 0 and page = 1)").select("scope", "page", "has_text").union(old.groupBy("scope").agg(F.max("page") + 1, F.lit(True)))
    pairs = old.where("fixed").select("scope", F.col("page").alias("old_page"), F.col("page").alias("new_page"), F.lit(True).alias("in_order"))
    found = pages.page_links(old, new, pairs)
    return found.select("scope", F.coalesce("old_page", F.lit(0)).alias("old_page"), F.coalesce("new_page", F.lit(0)).alias("new_page"), "kind", "comparable")


@query("""SELECT o_orderkey, CASE WHEN c_mktsegment IS NULL OR c_mktsegment = 'BUILDING' THEN 'unknown_sheet' WHEN o_orderkey % 5 = 0 THEN 'other_document' WHEN c_custkey % 4 = 0 THEN 'empty_cell'
  WHEN NOT (c_name = quote OR (right(quote, 1) = '…' AND starts_with(c_name, left(quote, length(quote) - 1)))) THEN 'not_quoted' END AS issue
FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'Customer#' || o_custkey WHEN 1 THEN 'Cust…' ELSE 'Cust' END AS quote FROM orders) LEFT JOIN customer ON c_custkey = o_custkey""")
def cell_evidence(spark, sf_dir):
    """Orders as evidence that quotes the name of their customer, a cell of the sheet of the customer's market segment."""
    c = table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    quote = F.when(k % 3 == 0, F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string"))).when(k % 3 == 1, "Cust…").otherwise("Cust")
    given = table(spark, sf_dir, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    given = given.select("o_orderkey", F.lit("new").alias("side"), F.col("c_mktsegment").alias("sheet"), F.col("o_custkey").alias("ref"), F.when(k % 5 == 0, "b").otherwise("a").alias("fingerprint"), quote.alias("excerpt"))
    cells = c.select(F.lit("new").alias("side"), F.col("c_mktsegment").alias("sheet"), F.col("c_custkey").alias("ref"), F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_name")).alias("text"))
    sheets = cells.where("sheet <> 'BUILDING'").select("side", "sheet", F.lit("a").alias("fingerprint")).distinct()
    return evidence.verify_cells(given, cells, sheets).select("o_orderkey", "issue")


@query("""SELECT o_custkey, o_orderkey, coalesce(lag(o_orderkey) OVER w, -1) AS previous, coalesce(lead(o_orderkey) OVER w, -1) AS next, row_number() OVER w AS place, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def report_steps(spark, sf_dir):
    found = report.steps(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")
    return found.select("o_custkey", "o_orderkey", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("previous", "next")), "place", "total")


@query("SELECT l_suppkey, l_partkey, min(l_orderkey * 10 + l_linenumber) AS seq, arg_min(l_returnflag, (l_orderkey * 10 + l_linenumber, l_returnflag)) AS l_returnflag FROM lineitem GROUP BY ALL")
def cell_highlights(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_returnflag")
    return report.highlights(cells, ["l_suppkey", "l_partkey"], "seq", "l_returnflag")


@query("""SELECT o_orderkey, coalesce(min(o_orderkey) FILTER (o_orderpriority = '1-URGENT') OVER (PARTITION BY o_custkey, o_orderstatus), o_orderkey) AS "group" FROM orders""")
def grouped_records(spark, sf_dir):
    found = report.page_groups(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey", F.col("o_orderpriority") == "1-URGENT")
    return found.select("o_orderkey", "group")


@query("""WITH a AS (SELECT o_custkey AS c, o_orderkey AS y, o_orderkey * 2 + o_orderkey % 5 AS t FROM orders WHERE o_orderkey % 3 = 0), p AS (SELECT o_custkey AS c, o_orderkey AS y FROM orders),
l AS (SELECT p.c, p.y, max(a.y) AS lo FROM p LEFT JOIN a ON a.c = p.c AND a.y <= p.y GROUP BY ALL), h AS (SELECT p.c, p.y, min(a.y) AS hi FROM p LEFT JOIN a ON a.c = p.c AND a.y > p.y GROUP BY ALL)
SELECT l.c AS scope, l.y::DOUBLE AS y, round(CASE WHEN lo IS NULL THEN b.t + l.y - hi WHEN hi IS NULL THEN d.t + l.y - lo ELSE d.t + (l.y - lo) / (hi - lo) * (b.t - d.t) END::DOUBLE, 3) AS "to"
FROM l JOIN h USING (c, y) LEFT JOIN a d ON d.c = l.c AND d.y = lo LEFT JOIN a b ON b.c = l.c AND b.y = hi""")
def scroll_positions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("y"))
    found = report.scrolled(o, o.where("y % 3 = 0").withColumn("to", F.expr("y * 2 + y % 5")), "scope")
    return found.withColumn("to", F.round("to", 3))


REPLIES = """s AS (SELECT o_custkey AS batch, o_orderkey AS change_id, CASE WHEN o_custkey % 9 = 2 AND o_orderkey % 4 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS ref, o_custkey % 7 = 0 AS torn, o_orderkey % 11 = 0 AS lost FROM orders),
r AS (SELECT batch, bool_or(torn) AS torn, bool_or(lost) AS lost FROM s GROUP BY batch)"""


def replies(spark, sf_dir):
    """The orders of a customer as one reply about its changes; some replies are torn, some speak of changes that were not asked for."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders")
    items = orders.select(c.alias("batch"), F.struct(o.alias("change_id"), F.lit("Changed.").alias("statement"), F.array(F.when((c % 9 == 2) & (o % 4 == 0), o + 1).otherwise(o)).alias("refs")).alias("item"))
    said = items.groupBy("batch").agg(F.to_json(F.array_sort(F.collect_list("item"))).alias("reply"))
    return said.select("batch", F.when(F.col("batch") % 7 == 0, F.concat(F.lit("Sure: "), "reply")).otherwise(F.col("reply")).alias("reply")), orders.where(o % 11 != 0).select(c.alias("batch"), o.alias("change_id"))


@query(f"""WITH {REPLIES} SELECT batch, CASE WHEN r.torn THEN 'unreadable' WHEN r.lost THEN 'unknown_change' ELSE 'none' END AS problem, CASE WHEN r.torn OR r.lost THEN -1 ELSE change_id END AS change_id FROM s JOIN r USING (batch) GROUP BY ALL""")
def checked_replies(spark, sf_dir):
    return explain.statements(*replies(spark, sf_dir)).select("batch", F.coalesce("problem", F.lit("none")).alias("problem"), F.coalesce("change_id", F.lit(-1)).alias("change_id"))


@query(f"""WITH {REPLIES} SELECT change_id, CASE WHEN ref <> change_id THEN 'foreign_reference' END AS problem FROM s JOIN r USING (batch) WHERE NOT r.torn AND NOT r.lost""")
def checked_references(spark, sf_dir):
    said = explain.statements(*replies(spark, sf_dir)).where("problem is null")
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref"), F.col("o_orderkey").alias("change_id"))
    return explain.references(said, facts).select("change_id", "problem")


@query("""WITH n AS (SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'F') AS n_changes, count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 2 = 0) AS n_explained FROM orders GROUP BY 1)
SELECT *, CASE WHEN n_changes = 0 THEN 'nothing_to_explain' WHEN n_explained = 0 THEN 'none' WHEN n_explained < n_changes THEN 'partial' ELSE 'complete' END AS status FROM n""")
def explained_share(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("change_id"), (F.col("o_orderstatus") == "F").alias("noise"))
    return explain.coverage(o, o.where("change_id % 2 = 0"), "o_custkey")


@query("""WITH t AS (SELECT user_id, event_id, event_type, row_number() OVER w AS rn, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, before, CASE WHEN rn = 1 THEN 'first' WHEN before = event_type THEN 'unchanged' ELSE 'changed' END AS state FROM t""")
def captures_since(spark, sf_dir):
    return explain.since_baseline(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "before", "state")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id <> user_id WHEN 1 THEN event_id <> user_id AND event_id % 3 <> 0 WHEN 2 THEN false ELSE true END AS opaque FROM events""")
def opaque_links(spark, sf_dir):
    """Links with a session each; every fourth has another page behind it, every fourth its parameters in another order."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("a"), F.col("user_id").cast("string").alias("b"))
    k, lit = F.col("event_id") % 4, F.lit
    first = F.concat(lit("https://shop.example/list?q=1&SID="), "a")
    page = F.when(F.col("event_id") % 3 == 0, "2").otherwise("1")
    second = F.when(k == 0, F.concat(lit("https://shop.example/list?q=1&SID="), "b")).when(k == 1, F.concat(lit("https://shop.example/list?q="), page, lit("&SID="), "b")).when(k == 2, F.concat(lit("https://shop.example/item?q=1&SID="), "b")).otherwise(F.concat(lit("https://shop.example/list?SID="), "b", lit("&%71=1")))
    return e.select("event_id", urls.opaque_difference(first, second).alias("opaque"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 4 = 0 OR length(l) > 12 THEN NULL ELSE l END AS label FROM (SELECT *, 'Due ' || repeat('x', (l_quantity::BIGINT % 12)::INT) AS r FROM lineitem), LATERAL (SELECT trim(r) AS l)""")
def value_labels(spark, sf_dir):
    name = F.concat(F.lit("Due "), F.repeat(F.lit("x"), (F.col("l_quantity").cast("long") % 12).cast("int")))
    line = F.concat(F.when(F.col("l_partkey") % 4 == 0, F.lit(" – ")).otherwise(F.concat(F.lit(" "), name)), F.lit(": $5 or $5"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", values.label_before(line, F.lit("$5"), 12).alias("label"))


@query(r"""WITH w AS (SELECT page_id, html, len(list_filter(string_split_regex(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+'), lambda x: x <> '')) AS n FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'needs_javascript' WHEN 1 THEN 'empty_page' ELSE CASE WHEN n >= 25 THEN NULL WHEN contains(html, '__NEXT_DATA__') THEN 'needs_javascript' WHEN n = 0 THEN 'empty_page' END END AS note FROM w""")
def render_notes(spark, sf_dir):
    """Pages, a third of them replaced by the shell of a script's page and a third by an empty one."""
    k = F.col("page_id") % 3
    shown = table(spark, sf_dir, "pages").select("page_id", F.when(k == 0, '<body><div class="x" id="root"> </div></body>').when(k == 1, "<html><body></body></html>").otherwise(F.col("html")).alias("html"))
    words = F.size(F.filter(F.split(F.regexp_replace("html", "<[^>]*>", " "), r"\s+"), lambda w: w != ""))
    return shown.select("page_id", html.render_note(F.col("html"), words).alias("note"))
