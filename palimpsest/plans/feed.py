"""Queries that read `lineitem` as a feed: an order's lines are changes of the comparison of its supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feed
from .registry import query, table

MODES = ["AIR", "BY HAND", "MAIL", "RAIL"]
FEED = """f AS (SELECT l_suppkey AS pair, l_orderkey * 10 + l_linenumber AS seq, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag <> 'A' THEN l_linenumber END AS new_page, CASE WHEN l_returnflag <> 'N' THEN (l_partkey % 7)::INT END AS old_page,
 l_linestatus = 'F' AS noise, l_returnflag AS category FROM lineitem)"""


def changes(spark, sf_dir):
    n, seq = F.col("l_linenumber"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("pair"), seq.alias("seq"), seq.alias("id"), F.when(F.col("l_returnflag") != "A", n).alias("new_page"), F.when(F.col("l_returnflag") != "N", (F.col("l_partkey") % 7).cast("int")).alias("old_page"),
        (F.col("l_linestatus") == "F").alias("noise"), F.col("l_returnflag").alias("category"),
    )


@query(f"WITH {FEED} SELECT pair, count(*) AS total, count(*) FILTER (NOT noise) AS meaningful, count(*) FILTER (noise) AS n_noise FROM f GROUP BY pair")
def feed_counts(spark, sf_dir):
    return feed.counts(changes(spark, sf_dir), "pair")


@query(f"""WITH {FEED}, n AS (SELECT category AS value, count(*) AS n FROM f WHERE NOT noise GROUP BY 1), r AS (SELECT unnest(['R', 'none', 'A']) AS value, unnest([1, 2, 3]) AS place)
SELECT coalesce(place, 3 + row_number() OVER (ORDER BY place IS NOT NULL, value))::BIGINT AS place, value, coalesce(n, 0) AS n FROM n FULL JOIN r USING (value)""")
def counts_in_order(spark, sf_dir):
    return feed.counts_in_order(feed.shown(changes(spark, sf_dir)), "category", ["R", "none", "A"])


@query(f"WITH {FEED} SELECT pair, count(DISTINCT new_page) AS pages, count(DISTINCT category) AS categories FROM f GROUP BY pair")
def affected_places(spark, sf_dir):
    return feed.affected(changes(spark, sf_dir), "pair", pages="new_page", categories="category")


@query(f"WITH {FEED}, l AS (SELECT pair, category, min(seq) AS first FROM f GROUP BY ALL) SELECT pair, category, first, row_number() OVER (PARTITION BY pair ORDER BY first, category) AS rank FROM l")
def first_seen_groups(spark, sf_dir):
    return feed.first_seen(changes(spark, sf_dir), "pair", "category", "seq")


@query(f"WITH {FEED} SELECT pair, seq, row_number() OVER (PARTITION BY pair ORDER BY noise, coalesce(new_page, old_page) NULLS LAST, seq) AS number FROM f")
def report_numbers(spark, sf_dir):
    return feed.numbered(changes(spark, sf_dir), "pair", feed.reading_order()).select("pair", "seq", "number")


@query(f"WITH {FEED} SELECT pair, id, row_number() OVER (PARTITION BY pair ORDER BY seq) AS seq FROM f WHERE category <> 'A'")
def renumbered_feed(spark, sf_dir):
    return feed.renumbered(changes(spark, sf_dir), "pair", "seq", F.col("category") != "A").select("pair", "id", "seq")


@query(f"""WITH {FEED}, t AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY CASE WHEN category = 'R' THEN 0 ELSE 1 END, coalesce(new_page, old_page) NULLS LAST, seq) AS r FROM f WHERE NOT noise)
SELECT pair, seq, row_number() OVER (PARTITION BY pair ORDER BY coalesce(new_page, old_page) NULLS LAST, seq) AS place FROM t WHERE r <= 20""")
def selected_changes(spark, sf_dir):
    """At most twenty changes of a comparison are explained; the number is the feature."""
    return feed.selected(changes(spark, sf_dir), "pair", F.col("category") == "R", feed.reading_order(), 20).select("pair", "seq", "place")


@query("""WITH a AS (SELECT o_orderkey AS note, o_custkey AS change FROM orders)
SELECT note, change, CASE WHEN change NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') THEN 'unknown_change' WHEN row_number() OVER (PARTITION BY change ORDER BY note) > 1 THEN 'duplicate' END AS problem FROM a""")
def attached_notes(spark, sf_dir):
    notes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note"), F.col("o_custkey").alias("change"))
    known = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("change"))
    return feed.attached(notes, known, "change", ["note"]).select("note", "change", "problem")


@query(f"""WITH {FEED}, g AS (SELECT * FROM f WHERE category = 'R'), p AS (SELECT DISTINCT pair, new_page FROM g)
SELECT pair, id FROM g UNION ALL SELECT pair, id FROM f WHERE category = 'N' AND (pair, new_page) IN (SELECT pair, new_page FROM p) AND (pair, id) NOT IN (SELECT pair, id FROM g)""")
def anchored_search(spark, sf_dir):
    f = changes(spark, sf_dir)
    return feed.anchored(f, f.where("category = 'R'"), ["pair", "new_page"], ["pair", "id"], F.col("category") == "N").select("pair", "id")


@query("""WITH s AS (SELECT array_to_string(list_slice(string_split(url, '/'), 3, 100), '/') AS section, page_id FROM pages)
SELECT page_id, section FROM s WHERE section = split_part(section, '/', 1) || '/fr' OR starts_with(section, split_part(section, '/', 1) || '/fr/')""")
def sections_within(spark, sf_dir):
    s = table(spark, sf_dir, "pages").select("page_id", F.array_join(F.slice(F.split("url", "/"), 3, 100), "/").alias("section"))
    return s.where(feed.within(F.regexp_replace("section", "^[^/]*/", ""), "fr"))


@query("SELECT coalesce(CASE WHEN event_type <> 'purchase' THEN event_type END, 'given') AS reason, count(*) AS n, sum(user_id)::BIGINT AS tokens FROM events GROUP BY 1")
def withheld_reasons(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "purchase", F.col("event_type")).alias("why"), "user_id")
    return feed.withheld(e, "why", tokens="user_id")
