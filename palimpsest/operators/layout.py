"""Pages of placed words: readability, columns, lines, spacing, blocks, headings.

Words: scope, page, word (long), text, x0, y0, x1, y1, size (double), bold (boolean). Every window and group is one page, whose words
are bounded by the page; sizes over a whole document are a plain aggregate, joined back by scope. Where pages are made in one piece, they are rows with an array of
words and stay so, in Arrow: no word is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Points, shares and counts that decide a page's layout.
GUTTER, COLUMN_WORDS, PAGE_WORDS = 24.0, 5, 12
SAME_LINE, CLUSTER, PARAGRAPH, INDENT, FONT_STEP, LEADING = 0.5, 1.2, 1.35, 12.0, 1.1, 1.25
HEADING_WORDS, HEADING_SIZE = 18, 1.15
BAD_GLYPHS, BAD_SHARE, SCANNED = 5, 0.3, 0.5
OWN = ("x0", "word", "text", "y0", "y1", "size", "bold")
WORDS = re.compile(r"[^ \t\n\x0B\f\r]+")


def text_layer(text: Column) -> Column:
    """absent, unreadable (glyph numbers, replacement or private characters in numbers) or present."""
    shown = F.length(F.regexp_replace(text, r"\s", ""))
    bad = F.regexp_count(text, F.lit(r"\(cid:[0-9]+\)|\x{FFFD}|[\x{E000}-\x{F8FF}]"))
    return F.when(F.coalesce(shown, F.lit(0)) == 0, "absent").when((bad >= BAD_GLYPHS) & (bad / shown >= BAD_SHARE), "unreadable").otherwise("present")


def is_scanned(layer: Column, image_area: Column, page_area: Column) -> Column:
    return (layer == "absent") & (F.least(F.lit(1.0), image_area / page_area) >= SCANNED)


def gutter(x0: np.ndarray, x1: np.ndarray, word: np.ndarray) -> float | None:
    """The middle of a page's widest gap, the first of equal ones, if that is a gutter with words enough on both sides."""
    if len(x0) < PAGE_WORDS:
        return None
    order = np.lexsort((word, x1, x0))
    starts, reach = x0[order][1:], np.maximum.accumulate(x1[order])[:-1]
    gaps = starts - reach
    k = int(np.argmax(gaps))  # places rise, so the first is the leftmost
    at = float(reach[k] + gaps[k] / 2)
    return at if gaps[k] >= GUTTER and (x1 <= at).sum() >= COLUMN_WORDS and (x0 >= at).sum() >= COLUMN_WORDS else None


def rows_of(boxes: list[tuple[float, float, float]]) -> list[int]:
    """Row of each (x0, y0, y1): the first row whose latest word it overlaps by half of the smaller height; rows count from the top."""
    latest: dict[int, tuple[float, float]] = {}
    held, found = [], [0] * len(boxes)
    for k in sorted(range(len(boxes)), key=lambda k: (boxes[k][1], boxes[k][0])):
        x, top, bottom = boxes[k]
        for row in [*latest]:
            a, b = latest[row]
            if b <= top:
                del latest[row]  # all words to come begin below it
            elif (low := min(b - a, bottom - top)) > 0 and min(b, bottom) - max(a, top) >= SAME_LINE * low:
                if x < held[row][1]:
                    held[row] = (held[row][0], x)
                break
        else:
            row = len(held)
            held.append((top, x))
        latest[row], found[k] = (top, bottom), row
    rank = {r: n for n, r in enumerate(sorted(range(len(held)), key=held.__getitem__))}
    return [rank[r] for r in found]


def _middle(values: list[float]) -> float | None:
    v = sorted(values)
    return 0.5 * v[(len(v) - 1) // 2] + 0.5 * v[len(v) // 2] if v else None


def _every(values: list[bool | None]) -> bool | None:
    known = [v for v in values if v is not None]
    return all(known) if known else None


def _page_lines(page: dict[str, list]) -> list[tuple]:
    """(column, line, text, x0, y0, size, bold) of a page's words. Where these have no column, it is 0, or 1 right of the gutter; a word across that goes by its left edge."""
    x0, word, text, y0, y1, size, bold = (page[c] for c in OWN)
    column = page.get("column")
    if column is None:
        at = gutter(*(np.array(page[c]) for c in ("x0", "x1", "word")))
        column = [0 if at is None or x < at else 1 for x in x0]
    order, nothing = np.lexsort((word, x0)).tolist(), float("-inf")
    if len(set(word)) < len(word):  # pages put together from several
        order.sort(key=lambda k: (x0[k], word[k], text[k] is not None, text[k] or "", y0[k], y1[k], nothing if size[k] is None else size[k], bold[k] is not None, bold[k]))
    out = []
    for c in sorted(set(column)):
        own = [k for k in order if column[k] == c]
        held: dict[int, list[int]] = {}
        for k, row in zip(own, rows_of([(x0[k], y0[k], y1[k]) for k in own]), strict=True):
            held.setdefault(row, []).append(k)
        for row in sorted(held):
            ks = held[row]
            shown = " ".join(text[k] for k in ks if text[k] is not None)
            out.append((c, row, shown, min(x0[k] for k in ks), min(y0[k] for k in ks), _middle([size[k] for k in ks if size[k] is not None]), _every([bold[k] for k in ks])))
    return out


def _spacing(rows: list[tuple]) -> float | None:
    """What spaced() says of a page's lines."""
    gaps = sorted(b[4] - a[4] for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and b[4] > a[4])
    if not gaps:
        return 0.0
    if len(gaps) == 1:
        usual = _middle([r[5] for r in rows if r[5] is not None and r[5] > 0])
        return gaps[0] if usual is None else min(gaps[0], usual * LEADING)
    reach = gaps[max(2, len(gaps) // 4) - 1]
    tight = next(g for g in gaps if g * CLUSTER >= reach)
    return _middle([g for g in gaps if g <= tight * CLUSTER])


def _page_blocks(page: dict[str, list]) -> list[tuple]:
    """(block, n_lines, n_words, size, bold) of a page's words, as blocks() and block_rows() give them."""
    rows = _page_lines(page)
    spacing, held = _spacing(rows), [rows[:1]]
    for a, b in zip(rows, rows[1:], strict=False):
        new = a[0] != b[0] or spacing > 0 and b[4] - a[4] > spacing * PARAGRAPH or abs(b[3] - a[3]) > INDENT or None not in (a[6], b[6]) and a[6] != b[6]
        if not new and None not in (a[5], b[5]):
            new = min(a[5], b[5]) > 0 and max(a[5], b[5]) / min(a[5], b[5]) > FONT_STEP
        if new:
            held.append([])
        held[-1].append(b)
    return [(k, len(own), sum(len(WORDS.findall(r[2])) for r in own), own[0][5], _every([r[6] for r in own])) for k, own in enumerate(held)]


def _from_pages(pages: DataFrame, of: Callable[[dict[str, list]], list[tuple]], fields: str) -> DataFrame:
    """What `of` makes of each page's words, with the page's scope and number."""
    out = T.StructType([*pages.select("scope", "page").schema, *T._parse_datatype_string(fields)])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                ends = np.cumsum(part.column(2).value_lengths().to_numpy(zero_copy_only=False)).tolist()
                flat = part.column(2).flatten()
                columns = {f.name: c.to_pylist() if (c := flat.field(f.name)).null_count or pa.types.is_string(f.type) else c.to_numpy(zero_copy_only=False).tolist() for f in flat.type}
                rows, at = [], []
                for n, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                    made = of({c: v[a:b] for c, v in columns.items()})
                    rows += made
                    at += [n] * len(made)
                at = pa.array(at, pa.int32())
                own = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *own], schema=schema)

    return pages.select("scope", "page", "words").mapInArrow(run, out)


LINE = "column int, line int, text string, x0 double, y0 double, size double, bold boolean"


def lines(words: DataFrame) -> DataFrame:
    """(scope, page, column, line, text, x0, y0, size, bold) of words with `column`; a line has the median size of its words and is bold
    if all of them are. Which row takes a word depends on the words before it, so a page is one row."""
    held = words.groupBy("scope", "page").agg(F.collect_list(F.struct("column", *OWN)).alias("words"))
    return page_lines(held)


def page_lines(pages: DataFrame) -> DataFrame:
    """lines() of pages that are rows: (scope, page, words), an array of structs of a word's columns. Words without `column` get theirs. Nothing is shuffled."""
    return _from_pages(pages, _page_lines, LINE)


def page_columns(pages: DataFrame) -> DataFrame:
    """(scope, page, n_right, n_words) of pages that are rows: how many words are right of the gutter."""

    def count(page: dict[str, list]) -> list[tuple]:
        x0, x1, word = (np.array(page[c]) for c in ("x0", "x1", "word"))
        at = gutter(x0, x1, word)
        return [(0 if at is None else int((x0 >= at).sum()), len(x0))]

    placed = F.arrays_zip(*(F.col(f"words.{c}").alias(c) for c in ("x0", "x1", "word")))
    return _from_pages(pages.select("scope", "page", placed.alias("words")), count, "n_right long, n_words long")


def page_blocks(pages: DataFrame) -> DataFrame:
    """block_rows() of the blocks of pages that are rows, as page_lines() takes them. Nothing is shuffled."""
    return _from_pages(pages, _page_blocks, "block int, n_lines long, n_words long, _size double, _bold boolean")


def body_sizes(pages: DataFrame) -> DataFrame:
    """(scope, body_size), the median size above 0 of all words of a scope's pages; sizes are counted page by page."""
    sizes = F.filter(F.col("words.size"), lambda x: x > 0)
    each = pages.select("scope", sizes.alias("_all")).select("scope", "_all", F.explode(F.array_distinct("_all")).alias("size"))
    each = each.select("scope", "size", F.size(F.filter("_all", lambda x: x == F.col("size"))).alias("_n"))
    return each.groupBy("scope", "size").agg(F.sum("_n").alias("_n")).groupBy("scope").agg(F.percentile("size", F.lit(0.5), F.col("_n")).alias("body_size"))


def spaced(page_lines: DataFrame) -> DataFrame:
    """page_lines with `spacing`, the usual distance of a page's lines: the median of its smallest cluster of gaps (as many of them within
    a tight gap's reach as are needed); with one gap alone no more than the type implies. Windows of one page, so one shuffle."""
    page = Window.partitionBy("scope", "page")
    was = lambda c: F.lag(c).over(page.orderBy("column", "line"))
    df = page_lines.withColumn("_gap", F.when((was("column") == F.col("column")) & (F.col("y0") > was("y0")), F.col("y0") - was("y0")))
    df = df.withColumns({"_rank": F.row_number().over(page.orderBy(F.col("_gap").asc_nulls_last())), "_n": F.count("_gap").over(page), "_widest": F.max("_gap").over(page), "_type": F.median(F.when(F.col("size") > 0, F.col("size"))).over(page)})
    need = F.greatest(F.lit(2), F.floor(F.col("_n") / 4))
    df = df.withColumn("_reach", F.max(F.when(F.col("_rank") == need, F.col("_gap"))).over(page))
    df = df.withColumn("_tight", F.min(F.when(F.col("_gap") * CLUSTER >= F.col("_reach"), F.col("_gap"))).over(page))
    df = df.withColumn("_usual", F.median(F.when(F.col("_gap") <= F.col("_tight") * CLUSTER, F.col("_gap"))).over(page))
    spacing = F.when(F.col("_n") == 0, 0.0).when(F.col("_n") == 1, F.least("_widest", F.col("_type") * LEADING)).otherwise(F.col("_usual"))
    return df.withColumn("spacing", spacing).drop("_gap", "_rank", "_n", "_widest", "_type", "_reach", "_tight", "_usual")


def blocks(page_lines: DataFrame) -> DataFrame:
    """page_lines with `spacing` and `block`, from 0 on each page: a new one at another column, after a wide gap, at an indent, a step in size or weight."""
    order = Window.partitionBy("scope", "page").orderBy("column", "line")
    was = lambda c: F.lag(c).over(order)
    step = F.greatest(was("size"), F.col("size")) / F.least(was("size"), F.col("size"))
    starts = (was("column") != F.col("column")) | ((F.col("spacing") > 0) & (F.col("y0") - was("y0") > F.col("spacing") * PARAGRAPH)) | (F.abs(F.col("x0") - was("x0")) > INDENT)
    starts = starts | ((F.least(was("size"), F.col("size")) > 0) & (step > FONT_STEP)) | (was("bold") != F.col("bold"))
    df = spaced(page_lines).withColumn("_new", F.coalesce(starts, F.lit(False)).cast("int"))
    return df.withColumn("block", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def block_rows(blocked: DataFrame) -> DataFrame:
    """(scope, page, block, n_lines, n_words, _size, _bold): the size of a block's first line, and whether all of its lines are bold."""
    n_words = F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")))
    return blocked.groupBy("scope", "page", "block").agg(F.count("*").alias("n_lines"), n_words.alias("n_words"), F.min_by("size", F.struct("column", "line")).alias("_size"), F.every("bold").alias("_bold"))


def headings(blocked: DataFrame, body: DataFrame) -> DataFrame:
    """(scope, page, block, n_lines, n_words, is_heading) of blocks() or page_blocks(); body: (scope, body_size), the median size of a document's words."""
    got = blocked if "_size" in blocked.columns else block_rows(blocked)
    large = (F.col("body_size") > 0) & (F.col("_size") >= F.col("body_size") * HEADING_SIZE)
    heading = (F.col("n_words") <= HEADING_WORDS) & (F.coalesce(large, F.lit(False)) | (F.col("_bold") & (F.col("n_lines") <= 2)))
    return got.join(body, "scope", "left").select("scope", "page", "block", "n_lines", "n_words", F.coalesce(heading, F.lit(False)).alias("is_heading"))
