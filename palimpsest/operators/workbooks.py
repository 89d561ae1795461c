"""Workbooks compared whole: sheets paired, rows and columns aligned, the rest joins over cells.

Cells are rows (book, sheet, sheet_index, row, col, kind, value, formula, link): book names a comparison, so many workbooks are compared at
once. Only the alignment of one sheet pair, which a workbook's limits bound, runs in one group.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..lineage import cut
from . import pages, pairing, sheets

LIKE_SHEET, LIKE_COLUMN, SAME_TOP, LIKE_ROW, PAIR_CAP, PREVIEW = 0.5, 0.34, 0.6, 0.5, 10_000, 8


def cell_key(kind: Column, value: Column, ignore_case: bool = False, ignore_space: bool = False) -> Column:
    """What cells are compared by: the number of numbers, dates and percents, else kind and text, folded as asked."""
    text = F.regexp_replace(F.trim(value), r"\s+", " ") if ignore_space else value
    text = F.lower(text) if ignore_case else text
    number = F.when(kind.isin("number", "date", "percent"), value.try_cast("double"))
    return F.when(number.isNotNull(), F.concat(F.lit("n:"), number.cast("string"))).otherwise(F.concat(kind, F.lit(":"), F.when(kind == "text", text).otherwise(value)))


def paired_sheets(old: DataFrame, new: DataFrame) -> DataFrame:
    """(book, old_sheet, new_sheet, old_index, new_index, how): by name, else the most alike first by bag overlap of their cells, then by distance of their places; null where unpaired.

    Empty sheets have no cells, so none arrive here. how: same, renamed, added or removed."""
    side = lambda df, s: df.select("book", F.col("sheet").alias(f"{s}_sheet"), F.col("sheet_index").alias(f"{s}_index")).distinct()
    a, b = side(old, "old"), side(new, "new")
    same = a.join(b, [a.book == b.book, F.col("old_sheet") == F.col("new_sheet")]).select(a.book, "old_sheet", "new_sheet", "old_index", "new_index", F.lit("same").alias("how"))
    left_a, left_b = a.join(same.select("book", "old_sheet"), ["book", "old_sheet"], "left_anti"), b.join(same.select("book", "new_sheet"), ["book", "new_sheet"], "left_anti")
    bag = lambda df, s, left: df.withColumnRenamed("sheet", f"{s}_sheet").join(left, ["book", f"{s}_sheet"], "left_semi").groupBy("book", f"{s}_sheet", "key").agg(F.count("*").alias(f"{s}_n"))
    x, y = bag(old, "old", left_a), bag(new, "new", left_b)
    total = lambda df, s: df.groupBy("book", f"{s}_sheet").agg(F.sum(f"{s}_n").alias(f"{s}_total"))
    shared = x.join(y, ["book", "key"]).groupBy("book", "old_sheet", "new_sheet").agg(F.sum(F.least("old_n", "new_n")).alias("n"))
    scored = shared.join(total(x, "old"), ["book", "old_sheet"]).join(total(y, "new"), ["book", "new_sheet"])
    scored = scored.select("book", "old_sheet", "new_sheet", (F.col("n") / (F.col("old_total") + F.col("new_total") - F.col("n"))).alias("score")).where(F.col("score") >= LIKE_SHEET)
    placed = scored.join(left_a, ["book", "old_sheet"]).join(left_b, ["book", "new_sheet"])
    renamed = pairing.one_to_one(placed, ["book"], "old_sheet", "new_sheet", [-F.col("score"), F.abs(F.col("old_index") - F.col("new_index")), F.col("old_index"), F.col("new_index")])
    renamed = renamed.select("book", "old_sheet", "new_sheet", "old_index", "new_index", F.lit("renamed").alias("how"))
    paired = same.union(renamed)
    gone = a.join(paired.select("book", "old_sheet"), ["book", "old_sheet"], "left_anti").select("book", "old_sheet", F.lit(None).cast("string"), "old_index", F.lit(None).cast("int"), F.lit("removed"))
    come = b.join(paired.select("book", "new_sheet"), ["book", "new_sheet"], "left_anti").select("book", F.lit(None).cast("string"), "new_sheet", F.lit(None).cast("int"), "new_index", F.lit("added"))
    return paired.union(gone).union(come)


def axis_pairs(old: list, new: list, alike, least: float) -> list[tuple[int, int]]:
    """Places of equal keys in order; between them the pairs in order of the greatest sum of likeness, each `least` or more. A gap of
    more than PAIR_CAP pairs is compared place by place."""
    out = []
    for tag, a, b, c, d in SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if tag == "equal":
            out += zip(range(a, b), range(c, d), strict=True)
            continue
        places = [(i, j) for i in range(a, b) for j in range(c, d)] if (b - a) * (d - c) <= PAIR_CAP else list(zip(range(a, b), range(c, d), strict=False))
        scored = [(i, j, s) for i, j in places if (s := alike(i, j)) >= least]
        out += [scored[k][:2] for k in pages.heaviest_chain(scored)]
    return out


def aligned_axes(old: pd.DataFrame, new: pd.DataFrame) -> list[tuple[str, int, int]]:
    """(axis, old number, new number) of the columns, then of the rows, of one sheet pair. Rows are compared over the paired columns."""
    table = [{c: dict(zip(g["row"], g["key"], strict=True)) for c, g in df.sort_values(["col", "row"]).groupby("col")} for df in (old, new)]
    cols = [sorted(t) for t in table]
    bags = [[Counter(t[c].values()) for c in cs] for t, cs in zip(table, cols, strict=True)]
    tops = [[next(iter(t[c].values())) for c in cs] for t, cs in zip(table, cols, strict=True)]

    def alike(i: int, j: int) -> float:
        p, q = bags[0][i], bags[1][j]
        both = sum((p & q).values())
        return max(both / (p.total() + q.total() - both), SAME_TOP if tops[0][i] == tops[1][j] else 0.0)

    whole = [[str(sorted(t[c].items())) for c in cs] for t, cs in zip(table, cols, strict=True)]
    paired = [(cols[0][i], cols[1][j]) for i, j in axis_pairs(*whole, alike, LIKE_COLUMN)]
    rows = [sorted(df["row"].unique().tolist()) for df in (old, new)]
    content = [[tuple(table[k][p[k]].get(r) for p in paired) for r in rows[k]] for k in (0, 1)]

    def alike_rows(i: int, j: int) -> float:
        seen = [(x, y) for x, y in zip(content[0][i], content[1][j], strict=True) if x is not None or y is not None]
        return sum(x == y for x, y in seen) / len(seen) if seen else 0.0

    return [("col", *p) for p in paired] + [("row", rows[0][i], rows[1][j]) for i, j in axis_pairs(*content, alike_rows, LIKE_ROW)]


def aligned(old: DataFrame, new: DataFrame, pairs: DataFrame) -> DataFrame:
    """(book, old_sheet, new_sheet, axis, old_at, new_at) for each sheet pair."""
    names = pairs.where("old_sheet is not null and new_sheet is not null").select("book", "old_sheet", "new_sheet")
    side = lambda df, s: df.withColumnRenamed("sheet", f"{s}_sheet").join(names, ["book", f"{s}_sheet"]).select("book", "old_sheet", "new_sheet", "row", "col", "key").groupBy("book", "old_sheet", "new_sheet")

    def one(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *x) for x in aligned_axes(a, b)], columns=["book", "old_sheet", "new_sheet", "axis", "old_at", "new_at"])

    return side(old, "old").cogroup(side(new, "new")).applyInPandas(one, "book long, old_sheet string, new_sheet string, axis string, old_at long, new_at long")


def reference(row: Column, col: Column) -> Column:
    return F.concat(sheets.column_letters(col), row.cast("string"))


def compare(old: DataFrame, new: DataFrame, ignore_case: bool = False, ignore_space: bool = False) -> DataFrame:
    """(book, seq, type, group, sheet, old_ref, new_ref, old_value, new_value, delta), numbered within each book.

    Types: sheet_added, sheet_removed, sheet_renamed, sheet_moved, column_added, column_removed, row_added, row_removed, row_moved, cell_added,
    cell_removed, cell_modified, formula_modified, result_modified, link_modified. A formula that reads as the old one moved with its cell is no
    change, nor is its result a typed-in value. The cells, the pairs of sheets and their axes are read several times, so the plan is cut there.
    """
    old, new = (cut(df.withColumn("key", cell_key(F.col("kind"), F.col("value"), ignore_case, ignore_space))) for df in (old, new))
    pairs = cut(paired_sheets(old, new))
    axes = cut(aligned(old, new, pairs))
    at = lambda axis: axes.where(F.col("axis") == axis).select("book", "old_sheet", "new_sheet", F.col("old_at").alias(f"old_{axis}"), F.col("new_at").alias(f"new_{axis}"))
    rows, cols = at("row"), at("col")
    names = pairs.where("how in ('same', 'renamed')").select("book", "old_sheet", "new_sheet")
    sided = lambda df, s: df.select("book", F.col("sheet").alias(f"{s}_sheet"), F.col("row").alias(f"{s}_row"), F.col("col").alias(f"{s}_col"), *(F.col(c).alias(f"{s}_{c}") for c in ("kind", "value", "key", "formula", "link"))).join(names, ["book", f"{s}_sheet"])
    a, b = sided(old, "old"), sided(new, "new")
    scope = ["book", "old_sheet", "new_sheet"]
    return _numbered(reduce(DataFrame.unionByName, [_sheets(pairs), *_lines(a, b, rows, cols, scope), _cells(a, b, rows, cols, scope)]))


def _feed(df: DataFrame, kind: Column, old_ref=None, new_ref=None, old_value=None, new_value=None, delta=None, section: int = 0, row=None, col=None) -> DataFrame:
    """Rows of one layer in the feed's columns, with where they stand."""
    none = F.lit(None).cast("string")
    text = {"old_ref": old_ref, "new_ref": new_ref, "old_value": old_value, "new_value": new_value, "delta": delta}
    return df.select("book", F.coalesce("new_sheet", "old_sheet").alias("sheet"), kind.alias("type"), *((none if v is None else v.cast("string")).alias(n) for n, v in text.items()), F.lit(section).alias("section"), *(F.coalesce(F.lit(0) if v is None else v, F.lit(0)).cast("long").alias(n) for n, v in (("at_row", row), ("at_col", col))))


def _sheets(pairs: DataFrame) -> DataFrame:
    def moved(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("old_index").reset_index(drop=True)
        return pdf[~pdf.index.isin(pages.longest_chain(pdf["new_index"].tolist()))]

    both = pairs.where("how in ('same', 'renamed')")
    named = _feed(pairs.where("how <> 'same'"), F.concat(F.lit("sheet_"), F.col("how")), old_value=F.col("old_sheet"), new_value=F.col("new_sheet"))
    order = both.groupBy("book").applyInPandas(moved, both.schema)
    return named.union(_feed(order, F.lit("sheet_moved"), old_value=F.col("old_index"), new_value=F.col("new_index")))


def _lines(a: DataFrame, b: DataFrame, rows: DataFrame, cols: DataFrame, scope: list[str]) -> list[DataFrame]:
    """Rows and columns that have no counterpart; a removed row and an added one of equal cells in equal columns are one moved row."""
    out = []
    mapped = a.join(cols, [*scope, "old_col"], "left").withColumn("c", F.coalesce("new_col", -F.col("old_col")))
    sides = [(mapped.join(rows, [*scope, "old_row"], "left_anti"), "old"), (b.withColumn("c", F.col("new_col")).join(rows, [*scope, "new_row"], "left_anti"), "new")]
    lists = []
    for df, s in sides:
        cells = F.array_sort(F.collect_list(F.struct("c", f"{s}_key", F.coalesce(f"{s}_formula", F.lit("")).alias("f"), F.col(f"{s}_value").alias("v"))))
        found = df.groupBy(*scope, f"{s}_row").agg(cells.alias("cells"), F.min(f"{s}_col").alias(f"{s}_first"), F.max(f"{s}_col").alias(f"{s}_last"))
        found = found.withColumns({f"{s}_preview": F.array_join(F.slice(F.transform("cells", lambda x: x["v"]), 1, PREVIEW), " | "), "same": F.sha2(F.to_json(F.transform("cells", lambda x: F.struct(x["c"], x[f"{s}_key"].alias("k")))), 256)}).drop("cells")
        lists.append(found.withColumn("rn", F.row_number().over(Window.partitionBy(*scope, "same").orderBy(f"{s}_row"))))
    both = lists[0].join(lists[1], [*scope, "same", "rn"], "full_outer")
    span = lambda s: F.when(F.col(f"{s}_row").isNotNull(), F.concat(reference(F.col(f"{s}_row"), F.col(f"{s}_first")), F.lit(":"), reference(F.col(f"{s}_row"), F.col(f"{s}_last"))))
    kind = F.when(F.col("old_row").isNull(), "row_added").when(F.col("new_row").isNull(), "row_removed").otherwise("row_moved")
    out.append(_feed(both, kind, span("old"), span("new"), F.col("old_preview"), F.col("new_preview"), section=2, row=F.coalesce("new_row", "old_row")))
    for df, s, what in ((a, "old", "column_removed"), (b, "new", "column_added")):
        found = df.join(cols, [*scope, f"{s}_col"], "left_anti").groupBy(*scope, f"{s}_col").agg(F.array_sort(F.collect_list(F.struct(f"{s}_row", f"{s}_value"))).alias("cells"))
        shown = F.array_join(F.slice(F.transform("cells", lambda x: x[f"{s}_value"]), 1, PREVIEW), " | ")  # noqa: B023
        out.append(_feed(found, F.lit(what), **{f"{s}_ref": sheets.column_letters(F.col(f"{s}_col")), f"{s}_value": shown}, section=1, col=F.col(f"{s}_col")))
    return out


def _cells(a: DataFrame, b: DataFrame, rows: DataFrame, cols: DataFrame, scope: list[str]) -> DataFrame:
    """Cells of paired rows and columns: one full outer join on where they stand in the new sheet."""
    x = a.join(rows, [*scope, "old_row"]).join(cols, [*scope, "old_col"])
    y = b.join(rows, [*scope, "new_row"]).join(cols, [*scope, "new_col"])
    both = x.join(y.drop("old_row", "old_col"), [*scope, "new_row", "new_col"], "full_outer")
    both = both.join(rows.withColumnRenamed("old_row", "was_row"), [*scope, "new_row"]).join(cols.withColumnRenamed("old_col", "was_col"), [*scope, "new_col"])
    both = both.withColumns({"old_row": F.coalesce("old_row", "was_row"), "old_col": F.coalesce("old_col", "was_col")})
    down, right = F.col("new_row") - F.col("old_row"), F.col("new_col") - F.col("old_col")
    follows = F.when(F.col("old_formula").isNotNull(), sheets.moved(F.col("old_formula"), down, right))
    both = both.withColumn("follows", follows)
    same_value, same_formula = F.col("old_key").eqNullSafe(F.col("new_key")), F.col("follows").eqNullSafe(F.col("new_formula"))
    kind = (
        F.when(F.col("old_key").isNull(), "cell_added").when(F.col("new_key").isNull(), "cell_removed").when(~same_formula, "formula_modified")
        .when(~same_value, F.when(F.col("new_formula").isNotNull(), "result_modified").otherwise("cell_modified")).when(~F.col("old_link").eqNullSafe(F.col("new_link")), "link_modified")
    )
    both = both.withColumn("what", kind).where("what is not null")
    was, now = (F.when(F.col("what") == "formula_modified", F.coalesce(f"{s}_formula", f"{s}_value")).when(F.col("what") == "link_modified", F.col(f"{s}_link")).otherwise(F.col(f"{s}_value")) for s in ("old", "new"))
    return _feed(both, F.col("what"), reference(F.col("old_row"), F.col("old_col")), reference(F.col("new_row"), F.col("new_col")), was, now, value_delta(), section=3, row=F.col("new_row"), col=F.col("new_col"))


def value_delta() -> Column:
    """How far a value moved: percentage points for percents, days for dates, else the number's difference."""
    a, b = (F.col(f"{s}_value").try_cast("decimal(28,8)") for s in ("old", "new"))
    kinds = lambda k: (F.col("old_kind") == k) & (F.col("new_kind") == k)
    points = (b - a) * 100
    sign = lambda x: F.when(x > 0, "+").otherwise("")
    plain = lambda x: F.regexp_replace(x.cast("string"), r"\.?0+$", "")
    days = F.floor(b) - F.floor(a)
    return F.when(a.isNull() | b.isNull() | (a == b), None).when(kinds("percent"), F.concat(sign(points), plain(points.cast("decimal(28,4)")), F.lit(" percentage points"))).when(kinds("date"), F.concat(F.abs(days).cast("string"), F.when(F.abs(days) == 1, " day ").otherwise(" days "), F.when(days > 0, "later").otherwise("earlier"))).when(kinds("number"), values.number_delta(a, b))


def group_of(kind: Column) -> Column:
    return F.when(kind.isin("formula_modified", "result_modified"), "formulas").when(kind == "link_modified", "links").when(kind.startswith("cell_"), "values").otherwise("structure")


def _numbered(feed: DataFrame) -> DataFrame:
    order = Window.partitionBy("book").orderBy("sheet", "section", "at_row", "at_col", "type", F.coalesce("old_ref", "old_value"), F.coalesce("new_ref", "new_value"))
    return feed.select("book", F.row_number().over(order).alias("seq"), "type", group_of(F.col("type")).alias("group"), "sheet", "old_ref", "new_ref", "old_value", "new_value", "delta")
