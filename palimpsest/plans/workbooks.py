"""Queries over workbooks made of `part`: 200 parts a book, an edited second version, compared whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import workbooks
from .registry import query, table

COLUMNS = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def book_cells(spark, sf_dir, new: bool):
    """Cells of the old or the new version. New: every thirteenth part is gone, every seventh costs 10 more, the first of a book stands
    last, the sheet has another name, and even books have a sheet of notes."""
    p = table(spark, sf_dir, "part").where("p_partkey is not null and p_name is not null").select("p_partkey", *(F.col(c).cast("string").alias(c) for c in COLUMNS[:4]), F.round("p_retailprice", 2).cast("decimal(18,2)").alias("p_retailprice"))
    k = F.col("p_partkey")
    p = p.withColumn("book", F.floor(k / 200).cast("long")).withColumn("n", k % 200)
    if new:
        p = p.where(k % 13 != 0).withColumns({"p_retailprice": F.when(k % 7 == 0, F.col("p_retailprice") + 10).otherwise(F.col("p_retailprice")).cast("decimal(18,2)"), "n": F.when(k % 200 == 1, 500).otherwise(k % 200)})
    rank = F.count("*").over(workbooks.Window.partitionBy("book").orderBy("n"))
    wide = p.select("book", rank.alias("row"), *COLUMNS[:4], F.col("p_retailprice").cast("string").alias("p_retailprice"))
    cells = wide.unpivot(["book", "row"], COLUMNS, "name", "value").where("value is not null")
    where = F.array_position(F.array(*map(F.lit, COLUMNS)), F.col("name")).cast("int")
    kind = F.when(F.col("name").isin("p_size", "p_retailprice"), "number").otherwise("text")
    none = F.lit(None).cast("string")
    out = cells.select("book", F.lit("stock" if new else "parts").alias("sheet"), F.lit(0).alias("sheet_index"), F.col("row").cast("int").alias("row"), where.alias("col"), kind.alias("kind"), "value", none.alias("formula"), none.alias("link"))
    if new:
        notes = wide.where("book % 2 = 0").select("book").distinct().select("book", F.lit("notes"), F.lit(1), F.lit(1), F.lit(1), F.lit("text"), F.lit("checked"), none, none)
        out = out.union(notes)
    return out


BOOKS = """p AS (SELECT *, p_partkey // 200 AS book, round(p_retailprice, 2)::DECIMAL(18,2) AS price FROM part WHERE p_partkey IS NOT NULL AND p_name IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY p_partkey % 200) AS r FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY CASE WHEN p_partkey % 200 = 1 THEN 500 ELSE p_partkey % 200 END) AS r FROM p WHERE p_partkey % 13 <> 0)"""


@query(f"""WITH {BOOKS}, f AS (
SELECT o.book, 'cell_modified' AS type, 'values' AS "group", 'E' || o.r AS old_ref, 'E' || n.r AS new_ref, o.price::VARCHAR AS old_value, (o.price + 10)::DECIMAL(18,2)::VARCHAR AS new_value FROM o JOIN n USING (p_partkey) WHERE p_partkey % 7 = 0 AND p_partkey % 200 <> 1
UNION ALL SELECT book, 'row_removed', 'structure', 'A' || r || ':E' || r, NULL, concat_ws(' | ', p_name, p_brand, p_type, p_size::INT::VARCHAR, price::VARCHAR), NULL FROM o WHERE p_partkey % 13 = 0
UNION ALL SELECT o.book, 'row_moved', 'structure', 'A' || o.r || ':E' || o.r, 'A' || n.r || ':E' || n.r, v, v FROM (SELECT *, concat_ws(' | ', p_name, p_brand, p_type, p_size::INT::VARCHAR, price::VARCHAR) AS v FROM o) o JOIN n USING (p_partkey) WHERE p_partkey % 200 = 1 AND p_partkey % 7 <> 0 AND o.book IN (SELECT book FROM n GROUP BY book HAVING count(*) > 1)
UNION ALL SELECT o.book, 'row_removed', 'structure', 'A' || o.r || ':E' || o.r, NULL, concat_ws(' | ', p_name, p_brand, p_type, p_size::INT::VARCHAR, price::VARCHAR), NULL FROM o WHERE p_partkey % 200 = 1 AND p_partkey % 7 = 0 AND p_partkey % 13 <> 0
UNION ALL SELECT n.book, 'row_added', 'structure', NULL, 'A' || n.r || ':E' || n.r, NULL, concat_ws(' | ', p_name, p_brand, p_type, p_size::INT::VARCHAR, (price + 10)::DECIMAL(18,2)::VARCHAR) FROM n WHERE p_partkey % 200 = 1 AND p_partkey % 7 = 0
UNION ALL SELECT DISTINCT book, 'sheet_renamed', 'structure', NULL, NULL, 'parts', 'stock' FROM n
UNION ALL SELECT DISTINCT book, 'sheet_added', 'structure', NULL, NULL, NULL, 'notes' FROM n WHERE book % 2 = 0)
SELECT book::BIGINT AS book, type, "group", old_ref, new_ref, old_value, new_value FROM f""")
def workbook_changes(spark, sf_dir):
    """All changes of each book, found by content; the SQL knows the parts' keys, the operator doesn't."""
    return workbooks.compare(book_cells(spark, sf_dir, False), book_cells(spark, sf_dir, True)).select("book", "type", "group", "old_ref", "new_ref", "old_value", "new_value")


@query(f"""WITH {BOOKS}, t AS (SELECT book, count(*) FILTER (p_partkey % 7 = 0 AND p_partkey % 13 <> 0 AND p_partkey % 200 <> 1) AS n FROM o GROUP BY book)
SELECT book::BIGINT AS book, n, '+10' AS least_delta FROM t WHERE n > 0""")
def workbook_deltas(spark, sf_dir):
    feed = workbooks.compare(book_cells(spark, sf_dir, False), book_cells(spark, sf_dir, True)).where("type = 'cell_modified'")
    return feed.groupBy("book").agg(F.count("*").alias("n"), F.min(F.regexp_replace("delta", r" .*$", "")).alias("least_delta"))
