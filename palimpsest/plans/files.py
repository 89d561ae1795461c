"""Queries on what files keep beside their text: page breaks, captures. The tables hold no such files; their events and captures are made of rows, alike in both dialects."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import lineage
from ..operators import paging
from ..sources import captures
from .registry import query, table

# A supplier's lines in order are a document's events; every third dozen of them is a table's row of three cells. The walk goes from event to event with page, content seen, hard break last,
# the same at the row's start, and the furthest end of a cell so far.
WALK = """n AS (SELECT l_suppkey AS scope, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS n, l_partkey AS k, l_quantity::INT % 4 AS q FROM lineitem WHERE l_suppkey IS NOT NULL),
e AS (SELECT scope, n, kind, CASE WHEN kind = 'text' THEN q ELSE 0 END AS words, r, c, CASE WHEN r IS NULL THEN n // 3 ELSE 1000000 + n // 4 END AS unit FROM (SELECT *, CASE WHEN k % 7 = 0 THEN 'hard' WHEN k % 7 < 3 THEN 'rendered'
  WHEN n % 3 = 0 AND k % 7 = 3 THEN 'before' WHEN k % 7 = 4 AND n % 3 = 1 THEN 'object' ELSE 'text' END AS kind, CASE WHEN n // 12 % 3 = 1 THEN n // 12 END AS r, CASE WHEN n // 12 % 3 = 1 THEN n % 12 // 4 END AS c FROM n)),
w(scope, n, r, c, s, began, best, page, counts) AS (SELECT DISTINCT scope, -1::BIGINT, NULL::BIGINT, NULL::BIGINT, {'p': 1::BIGINT, 'seen': false, 'hard': false}, {'p': 1::BIGINT, 'seen': false, 'hard': false}, {'p': 1::BIGINT, 'seen': false, 'hard': false}, 1::BIGINT, false FROM e
  UNION ALL SELECT scope, n, r, c, {'p': st.p + counts::INT, 'seen': st.seen OR content, 'hard': CASE WHEN kind = 'hard' OR (kind = 'before' AND counts) THEN true WHEN content THEN false ELSE st.hard END}, began, best, st.p, counts
  FROM (SELECT *, kind = 'object' OR (kind = 'text' AND words > 0) AS content, kind = 'hard' OR (kind = 'rendered' AND NOT st.hard) OR (kind = 'before' AND r IS NULL AND st.seen) AS counts
    FROM (SELECT scope, n, kind, words, r, c, CASE WHEN r IS NOT DISTINCT FROM r0 AND c IS DISTINCT FROM c0 THEN began ELSE here END AS st, CASE WHEN r IS NOT NULL AND r IS DISTINCT FROM r0 THEN here ELSE began END AS began,
      CASE WHEN r IS NOT NULL AND r IS DISTINCT FROM r0 THEN here ELSE best END AS best
      FROM (SELECT *, CASE WHEN r0 IS NOT NULL AND r IS DISTINCT FROM r0 THEN best ELSE s END AS here
        FROM (SELECT e.*, w.r AS r0, w.c AS c0, w.s, w.began, CASE WHEN w.r IS NOT NULL AND (e.r IS DISTINCT FROM w.r OR e.c IS DISTINCT FROM w.c) AND w.s.p > w.best.p THEN w.s ELSE w.best END AS best FROM w JOIN e ON e.scope = w.scope AND e.n = w.n + 1))))),
f AS (SELECT e.*, w.page, w.counts FROM w JOIN e USING (scope, n))"""


def break_events(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").where("l_suppkey is not null")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    e = line.select(F.col("l_suppkey").alias("scope"), (F.row_number().over(w) - 1).cast("long").alias("pos"), (F.col("l_partkey") % 7).alias("k"), (F.col("l_quantity").cast("int") % 4).alias("q"))
    n, k = F.col("pos"), F.col("k")
    dozen, third = F.floor(n / 12), n % 3
    kind = F.when(k == 0, "hard").when(k < 3, "rendered").when((third == 0) & (k == 3), "before").when((k == 4) & (third == 1), "object").otherwise("text")
    row = F.when(dozen % 3 == 1, dozen)
    return e.select("scope", "pos", F.when(row.isNull(), F.floor(n / 3)).otherwise(1000000 + F.floor(n / 4)).alias("unit"), kind.alias("kind"), F.when(kind == "text", F.col("q")).otherwise(0).alias("words"), row.alias("row"), F.when(row.isNotNull(), F.floor(n % 12 / 4)).alias("cell"))


@query(f"""WITH RECURSIVE {WALK}, a AS (SELECT *, sum(words) OVER (PARTITION BY scope, unit ORDER BY n) - words AS ahead, sum(words) OVER (PARTITION BY scope, unit) AS all_words FROM f)
SELECT scope, unit, arg_min(page, n) FILTER (kind = 'text' AND words > 0) AS page, coalesce(string_agg(ahead::INT::VARCHAR, ' ' ORDER BY ahead) FILTER (kind IN ('hard', 'rendered') AND counts AND ahead > 0 AND ahead < all_words), '') AS breaks
FROM a WHERE all_words > 0 GROUP BY scope, unit""")
def unit_pages(spark, sf_dir):
    """The page of each unit's first word and where in it further pages begin."""
    found = paging.units(paging.numbered(break_events(spark, sf_dir)))
    return found.withColumn("breaks", F.array_join("breaks", " "))


@query(f"""WITH RECURSIVE {WALK}, x AS (SELECT scope, sum(words) AS words, max(page + counts::INT) AS pages FROM f GROUP BY scope),
s AS (SELECT *, CASE WHEN scope % 5 <> 0 THEN pages + CASE WHEN scope % 5 = 1 THEN 1 ELSE 0 END END AS stored_pages, CASE WHEN scope % 11 = 0 THEN 0 ELSE words + scope % 13 * 2 * (words // 100) END AS stored_words FROM x)
SELECT scope, words::BIGINT AS words, pages, CASE WHEN reason IS NULL THEN 'recorded' ELSE 'unavailable' END AS status, reason FROM (SELECT *, CASE WHEN words = 0 THEN 'empty' WHEN stored_pages IS NULL THEN 'no_statistics'
  WHEN stored_words = 0 OR abs(stored_words - words) > greatest(10, round_even(words * 0.15::DOUBLE, 0)) THEN 'statistics_out_of_date' WHEN pages <> stored_pages THEN 'pages_disagree' END AS reason FROM s)""")
def page_trust(spark, sf_dir):
    """Whether each document's pages can be believed, by statistics that are made of what was counted."""
    extent = paging.extents(paging.numbered(break_events(spark, sf_dir)))
    k, words = F.col("scope"), F.col("words")
    stored = extent.select("scope", F.when(k % 5 != 0, F.col("pages") + F.when(k % 5 == 1, 1).otherwise(0)).alias("stored_pages"), F.when(k % 11 == 0, 0).otherwise(words + k % 13 * 2 * F.floor(words / 100)).alias("stored_words"))
    return paging.trusted(extent, stored)


# Each page's capture goes to a folder and comes back. Of every eleven lines one is torn halfway, one is of an older version, one lost its last node after it was signed; every third is a baseline.
@query("""WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, len(string_split(coalesce(html, ''), chr(10))) AS n, page_id % 11 AS k FROM pages WHERE page_id IS NOT NULL),
r AS (SELECT *, CASE WHEN k = 0 THEN 'not_json' WHEN k = 1 THEN 'old_version' WHEN url IS NULL THEN 'malformed' WHEN n - (k = 2)::INT > 5000 THEN 'too_many_nodes' WHEN k = 2 THEN 'altered' END AS reason FROM p)
SELECT page_id, reason, CASE WHEN reason IS NULL THEN url END AS url, CASE WHEN reason IS NULL AND page_id % 3 = 0 THEN 'page ' || page_id END AS label, CASE WHEN reason IS NULL THEN n END AS n_nodes, CASE WHEN reason IS NULL THEN sha256(html) END AS sha256 FROM r""")
def captures_kept(spark, sf_dir):
    """What came back of the captures of all pages, and why what did not."""
    captures.register(spark)
    k, nodes, line = F.col("page_id") % 11, F.col("nodes"), F.col("line")
    pages = table(spark, sf_dir, "pages").where("page_id is not null").select("page_id", "url", captures.nodes_of(F.coalesce("html", F.lit(""))).alias("nodes"))
    kept = F.when(k == 2, F.slice(nodes, F.lit(1), F.size(nodes) - 1)).otherwise(nodes)
    made = captures.line(F.col("url"), F.col("page_id").cast("string"), F.lit(None).cast("string"), kept, F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("page "), F.col("page_id").cast("string"))), captures.signed(nodes), F.when(k == 1, 0).otherwise(captures.VERSION))
    lines = pages.select(k.alias("k"), made.alias("line")).select(F.when(F.col("k") == 0, F.left(line, F.floor(F.length(line) / 2).cast("int"))).otherwise(line).alias("line"))
    folder = lineage.folder(spark)
    lines.write.format("captures").mode("append").save(folder)
    found = spark.read.format("captures").load(folder)
    told = F.coalesce("captured_at", F.regexp_extract("raw", r'"captured_at":"(-?\d+)"', 1)).cast("long")
    return found.select(told.alias("page_id"), "reason", "url", "label", F.when(F.col("reason").isNull(), F.size("nodes").cast("long")).alias("n_nodes"), F.sha2(F.array_join("nodes.text", "\n"), 256).alias("sha256"))
