"""Web pages compared whole: metadata, headings and blocks, links, tables; each layer joins, only the order of blocks is aligned in a group.

Pages are rows (page_id, url, html); page_id names a comparison. A layer's changes are (page_id, layer, kind, category, label, old_value, new_value, difference, noise).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..lineage import cut
from ..sources import html
from . import align, diff, noise, segments

FIELDS = ["address", "title", "description", "canonical", "lang"]


def metadata(url: Column, page: Column) -> list[Column]:
    """Columns of FIELDS; empty ones are null. Attributes may stand in any order and be quoted in any way."""
    decoded = lambda c: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")], c)
    one = lambda pattern, *groups: F.nullif(text.normalize(decoded(F.concat(*(F.regexp_extract(page, pattern, k) for k in groups or (1,))))), F.lit(""))
    value = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    attribute = lambda tag, has, name: one(rf"""(?is)<{tag}\b{rf"""(?=[^>]*\s{has[0]}\s*=\s*["']?{has[1]}["'\s/>])""" if has else ""}[^>]*?\s{name}\s*=\s*{value}""", 1, 2, 3)
    found = [urls.strip_tracking(url), one(r"(?is)<title[^>]*>(.*?)</title>"), attribute("meta", ("name", "description"), "content"), attribute("link", ("rel", "canonical"), "href"), attribute("html", None, "lang")]
    return [c.alias(n) for n, c in zip(FIELDS, found, strict=True)]


def metadata_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    fields = lambda df: df.select("page_id", *metadata(F.col("url"), F.col("html"))).unpivot("page_id", FIELDS, "field", "value").where("value is not null")
    return _feed(diff.changes(fields(old), fields(new), ["page_id", "field"]), "metadata", F.col("field"))


COLUMNS = ["page_id", "layer", "kind", "category", "label", "old_value", "new_value", "difference", "noise"]


def _feed(df: DataFrame, layer, label: Column, reason: Column | None = None, category: Column | None = None, difference: Column | None = None) -> DataFrame:
    layer = F.lit(layer) if isinstance(layer, str) else layer
    none = F.lit(None).cast("string")
    own = {"layer": layer, "label": label, "noise": none if reason is None else reason, "category": F.lit("text") if category is None else category, "difference": none if difference is None else difference}
    return df.select(*(own[c].alias(c) if c in own else c for c in COLUMNS))


def link_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links are aligned by their texts, reworded ones with what they were; the addresses of a pair are compared without tracking parameters.
    One that only another session or cache makes different is noise."""
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("idx")).cast("long")
    side = lambda df: df.where("role = 'link'").select("page_id", nth.alias("place"), "href", "text")
    a, b = side(old), side(new)
    pairs = cut(align.align(a.withColumnRenamed("page_id", "scope"), b.withColumnRenamed("page_id", "scope")).select(F.col("scope").alias("page_id"), "old_place", "new_place"))
    same = a.select("page_id", F.col("place").alias("old_place"), F.col("place").alias("new_place")).join(pairs.select("page_id").distinct(), "page_id", "left_anti")
    shown = lambda df, s: df.select("page_id", F.col("place").alias(f"{s}_place"), F.col("href").alias(f"{s}_value"), F.col("text").alias(f"{s}_text"))
    both = pairs.union(same).join(shown(a, "old"), ["page_id", "old_place"], "left").join(shown(b, "new"), ["page_id", "new_place"], "left").where("not (old_value <=> new_value)")
    kind = F.when(F.col("old_text").isNull(), "added").when(F.col("new_text").isNull(), "removed").otherwise("modified")
    reason = F.when(urls.opaque_difference(F.col("old_value"), F.col("new_value")), "opaque_link")
    return _feed(both.withColumn("kind", kind), "link", F.coalesce("new_text", "old_text"), reason, F.lit("link"))


def table_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells of tables of the same number: rows by first cell where that is unique and non-empty on both sides, else by place. Columns pair by their head, which is a cell of the first
    row of header cells only, and what is left by place. A row or column without a counterpart is one change. A cell is labelled with its row's first cell and its column's head; of a
    table without header cells, with the first row's cell if that did not change."""
    side = lambda df: df.where("place is not null").select("page_id", F.concat_ws("/", "page_id", "place.tbl").alias("tbl"), "place.row", "place.col", "place.head", "text", text.key(F.col("text")).alias("key"))
    a, b = side(old), side(new)
    joined = lambda by, to: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "text"))), lambda x: x["text"]), " · ").alias(to)
    firsts = lambda df: df.groupBy("page_id", "tbl", "row").agg(F.min_by("key", "col").alias("first"), F.min_by("text", "col").alias("named"), F.bool_and("head").alias("heads"), joined("col", "shown"))
    rows_a, rows_b = firsts(a), firsts(b)
    pairs = diff.keyed_or_positional(rows_a.select("tbl", "row", "first"), rows_b.select("tbl", "row", "first"), "tbl", "first", "row")
    shown = lambda df, s: df.select("page_id", "tbl", F.col("row").alias(f"{s}_place"), F.col("shown").alias(f"{s}_value"), F.col("named").alias(f"{s}_named"))
    alone = pairs.where("old_place is null or new_place is null").join(shown(rows_a, "old").withColumnRenamed("page_id", "p"), ["tbl", "old_place"], "left").join(shown(rows_b, "new").withColumnRenamed("page_id", "q"), ["tbl", "new_place"], "left")
    alone = alone.select(F.coalesce("p", "q").alias("page_id"), F.when(F.col("old_place").isNull(), "added").otherwise("removed").alias("kind"), F.coalesce("new_named", "old_named").alias("label"), "old_value", "new_value")

    def columns(df: DataFrame, rows: DataFrame, s: str) -> DataFrame:
        """(tbl, <s>_col, head, nth): each column, its head's key, and its number among those of that head."""
        top = rows.where("heads").groupBy("tbl").agg(F.min("row").alias("row"))
        heads = df.join(top, ["tbl", "row"]).where("key <> ''").select("tbl", "col", F.col("key").alias("head"), F.col("text").alias("head_text"), F.col("row").alias("head_row"))
        every = df.groupBy("page_id", "tbl", "col").agg(joined("row", "shown")).join(heads, ["tbl", "col"], "left")
        nth = F.row_number().over(Window.partitionBy("tbl", "head").orderBy("col"))
        return every.select("tbl", F.col("page_id").alias(f"{s}_page"), F.col("col").alias(f"{s}_col"), "head", "head_text", "head_row", F.when(F.col("head").isNotNull(), nth).alias("nth"), F.col("shown").alias(f"{s}_value"))

    x, y = columns(a, rows_a, "old"), columns(b, rows_b, "new")
    by_head = x.select("tbl", "head", "nth", "old_col").join(y.select("tbl", "head", "nth", "new_col"), ["tbl", "head", "nth"]).select("tbl", "old_col", "new_col")
    rest_x, rest_y = x.join(by_head, ["tbl", "old_col"], "left_anti"), y.join(by_head, ["tbl", "new_col"], "left_anti")
    by_place = rest_x.select("tbl", "old_col").join(rest_y.select("tbl", "new_col"), "tbl").where("old_col = new_col")
    matched = by_head.union(by_place.select("tbl", "old_col", "new_col"))
    both_sides = x.select("tbl").distinct().join(y.select("tbl").distinct(), "tbl", "left_semi")
    lone = lambda df, s, o, kind: df.join(matched, ["tbl", f"{s}_col"], "left_anti").join(both_sides, "tbl", "left_semi").select(F.col(f"{s}_page").alias("page_id"), F.lit(kind).alias("kind"), F.coalesce("head_text", F.concat(F.lit("#"), F.col(f"{s}_col").cast("string"))).alias("label"), *((F.col(c) if c == f"{s}_value" else F.lit(None).cast("string")).alias(c) for c in ("old_value", "new_value")))
    alone = alone.union(lone(x, "old", "new", "removed")).union(lone(y, "new", "old", "added"))
    cell = lambda df, s: df.select("tbl", F.col("row").alias(f"{s}_place"), F.col("col").alias(f"{s}_col"), F.col("page_id").alias(f"{s}_page"), text.normalize(F.col("text")).alias(f"{s}_value"), F.col("key").alias(f"{s}_key"))
    met = pairs.where("old_place is not null and new_place is not null").join(matched, "tbl").join(cell(a, "old"), ["tbl", "old_place", "old_col"]).join(cell(b, "new"), ["tbl", "new_place", "new_col"])
    head = y.select("tbl", "new_col", "head_text", "head_row")
    first = met.where("old_key = new_key").join(rows_b.groupBy("tbl").agg(F.min("row").alias("new_place")), ["tbl", "new_place"]).select("tbl", "new_col", F.col("new_place").alias("_top"), F.col("new_value").alias("_first"))
    changed = met.where("old_key <> new_key").join(rows_b.select("tbl", F.col("row").alias("new_place"), "named"), ["tbl", "new_place"]).join(head, ["tbl", "new_col"], "left").join(first, ["tbl", "new_col"], "left")
    column = F.coalesce(F.when(F.col("new_place") != F.col("head_row"), F.col("head_text")), F.when(F.col("head_row").isNull() & (F.col("new_place") > F.col("_top")), F.col("_first")))
    changed = changed.select(F.col("new_page").alias("page_id"), F.lit("modified").alias("kind"), F.when(F.col("new_col") == 0, F.col("named")).otherwise(F.concat_ws(" · ", "named", F.nullif(column, F.lit("")))).alias("label"), "old_value", "new_value", segments.value_change(F.col("old_value"), F.col("new_value")).alias("_c"))
    return _feed(alone, "table", F.col("label"), category=F.lit("table")).union(_feed(changed, "table", F.col("label"), category=F.coalesce("_c.category", F.lit("table")), difference=F.col("_c.difference")))


def renamed_headings(old: DataFrame, new: DataFrame) -> DataFrame:
    """(page_id, old_idx, new_idx): headings of one level with different texts and the same, non-empty text beneath; first come, first served."""

    def side(df: DataFrame, s: str) -> DataFrame:
        w = Window.partitionBy("page_id").orderBy("idx")
        d = df.where("role not in ('link', 'warning')").withColumn("n", F.sum((F.col("role") == "heading").cast("int")).over(w))
        prose = d.where("role <> 'heading' and n > 0").groupBy("page_id", "n").agg(F.sha2(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("idx", text.key(F.col("text")).alias("k")))), lambda x: x["k"])), 256).alias("prose"))
        heads = d.where("role = 'heading'").join(prose, ["page_id", "n"]).select("page_id", "idx", "level", "prose", text.key(F.col("text")).alias("key"))
        rank = F.row_number().over(Window.partitionBy("page_id", "level", "prose").orderBy("idx"))
        return heads.select("page_id", "level", "prose", rank.alias("rn"), F.col("idx").alias(f"{s}_idx"), F.col("key").alias(f"{s}_key"))

    return side(old, "old").join(side(new, "new"), ["page_id", "level", "prose", "rn"]).where("old_key <> new_key").select("page_id", "old_idx", "new_idx")


def block_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Headings and blocks of text, aligned in order; renamed headings are modified ones. A block that moved within its section is noise."""
    names = renamed_headings(old, new)
    blocks = lambda df: df.where("role not in ('link', 'table_cell', 'warning')")
    scope = lambda df: blocks(df).select(F.col("page_id").alias("scope"), F.col("idx").cast("long").alias("place"), "text")
    changes = align.align(scope(old), scope(new)).where("kind <> 'equal'").select(F.col("scope").alias("page_id"), "kind", F.col("old_place").alias("old_idx"), F.col("new_place").alias("new_idx"))
    changes = changes.join(names.select("page_id", "old_idx"), ["page_id", "old_idx"], "left_anti").join(names.select("page_id", "new_idx"), ["page_id", "new_idx"], "left_anti")
    changes = changes.select("page_id", "kind", "old_idx", "new_idx").union(names.select("page_id", F.lit("modified"), F.col("old_idx").cast("long"), F.col("new_idx").cast("long")))
    shown = lambda df, s: blocks(df).select("page_id", F.col("idx").cast("long").alias(f"{s}_idx"), F.col("text").alias(f"{s}_value"), F.col("role").alias(f"{s}_role"), F.array_join("section_path", " > ").alias(f"{s}_path"))
    both = changes.join(shown(old, "old"), ["page_id", "old_idx"], "left").join(shown(new, "new"), ["page_id", "new_idx"], "left")
    role = F.coalesce("new_role", "old_role")
    label = F.when(role == "heading", F.coalesce("new_value", "old_value")).otherwise(F.coalesce("new_path", "old_path"))
    reason = F.when((F.col("kind") == "moved") & F.col("old_path").eqNullSafe(F.col("new_path")), "moved").otherwise(noise.reason(F.col("old_value"), F.col("new_value"), F.col("kind")))
    both = cut(both.select("page_id", "kind", "old_value", "new_value", F.when(role == "heading", "heading").otherwise("block").alias("layer"), label.alias("label"), reason.alias("noise")))
    split = (F.col("kind") == "modified") & (F.col("layer") == "block")
    shown = both.where(split).select("page_id", "layer", "label", "noise", text.normalize(F.col("old_value")).alias("old_text"), text.normalize(F.col("new_value")).alias("new_text"))
    changed = segments.typed(shown.withColumn("segments", align.segments("old_text", "new_text")))
    return _feed(both.where(~split), F.col("layer"), F.col("label"), F.col("noise")).union(_feed(changed, F.col("layer"), F.col("label"), F.col("noise"), F.col("category"), F.col("difference")))


def page_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages that one side has, by their addresses."""
    side = lambda df, other, kind, to: df.select("page_id", "url").join(other.select("page_id"), "page_id", "left_anti").select("page_id", F.lit(kind).alias("kind"), *((F.col("url") if c == to else F.lit(None).cast("string")).alias(c) for c in ("old_value", "new_value")))
    both = side(old, new, "removed", "old_value").union(side(new, old, "added", "new_value"))
    return _feed(both, "page", F.coalesce("new_value", "old_value"))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """All layers' changes; a page of one side only is one change of layer page. noise: why a change is of no interest, else null; noisy changes are marked, not dropped.

    A block that changed gives a row for each typed change in it: whole dates, then what is left of its runs of words."""
    pages = page_changes(old, new)
    shared = old.select("page_id").join(new.select("page_id"), "page_id", "left_semi").distinct()
    old, new = (df.select("page_id", "url", "html").join(shared, "page_id", "left_semi") for df in (old, new))
    a, b = (cut(html.units(df.repartition("page_id"), loose=True)) for df in (old, new))  # a table may be one file, and reading pages is work for many
    return reduce(DataFrame.union, [pages, metadata_changes(old, new), block_changes(a, b), link_changes(a, b), table_changes(a, b)])
