"""Layout, structure, formats and files: queries against their SQL, and what SQL can't say against small cases."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import formats
from palimpsest.operators import exports, layout, marks, structure
from palimpsest.plans import documents, registry, workbooks  # noqa: F401
from palimpsest.sources import office

from .test_own import DATA, duck, one, plain  # noqa: F401

NAMES = sorted(n for n, q in registry.QUERIES.items() if q.__module__ == documents.__name__)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):  # noqa: F811
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLE_SQL:
        assert plain(got) == plain(duck.sql(registry.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_rows_overlap_by_half():
    assert layout.rows_of([(0, 0, 10), (20, 4, 14), (40, 9, 19), (5, 20, 30)]) == [0, 0, 0, 1]
    assert layout.rows_of([(0, 20, 30), (0, 0, 10), (9, 6, 16)]) == [2, 0, 1]
    assert layout.rows_of([]) == []


def test_spacing(spark):
    pages, rows = [[], [30.0], [12.0, 24.0, 12.0, 24.0, 12.5], [12.0, 30.0]], []
    for p, gaps in enumerate(pages):
        rows += [(1, p, 0, k, 0.0, sum(gaps[:k], 0.0), 10.0, False) for k in range(len(gaps) + 1)]
    df = layout.spaced(spark.createDataFrame(rows, "scope long, page long, column int, line int, x0 double, y0 double, size double, bold boolean"))
    assert {r.page: r.spacing for r in df.collect()} == {0: 0.0, 1: 12.5, 2: 12.0, 3: 21.0}


def test_blocks_and_headings(spark):
    page = [(1, 0, 0, 0, "Title", 0.0, 0.0, 20.0, False), (1, 0, 0, 1, "a b", 0.0, 30.0, 10.0, False), (1, 0, 0, 2, "c", 0.0, 42.0, 10.0, False), (1, 0, 0, 3, "d", 0.0, 54.0, 10.0, False), (1, 0, 0, 4, "e", 0.0, 90.0, 10.0, False), (1, 0, 1, 0, "f", 300.0, 0.0, 10.0, True)]
    df = layout.blocks(spark.createDataFrame(page, "scope long, page long, column int, line int, text string, x0 double, y0 double, size double, bold boolean"))
    assert [r.block for r in df.orderBy("column", "line").collect()] == [0, 1, 1, 1, 2, 3]
    body = spark.createDataFrame([(1, 10.0)], "scope long, body_size double")
    assert {r.block: r.is_heading for r in layout.headings(df, body).collect()} == {0: True, 1: False, 2: False, 3: True}


def test_tables_pair_best_first(spark):
    rows = [(1, 0, 0, 0.5), (1, 0, 1, 0.9), (1, 1, 1, 0.9), (1, 1, 0, 0.4), (2, 0, 5, 0.2)]
    got = structure.paired_tables(spark.createDataFrame(rows, "scope long, old long, new long, overlap double"))
    assert sorted((r.scope, r.old, r.new) for r in got.collect()) == [(1, 0, 0), (1, 1, 1)]


def test_batches_close_by_count_and_size(spark):
    items = spark.createDataFrame([(1, k, s) for k, s in enumerate([5, 5, 5, 100, 1, 1, 1, 1])], "scope long, place long, size long")
    got = [r.batch for r in structure.batches(items, most=3, chars=12).orderBy("place").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 3, 4]
    assert structure.batches(items.where("false")).count() == 0


def test_grounding(spark):
    found = lambda s, m: [float(x) for x in one(spark, structure.ungrounded(F.lit(s), F.lit(m)))]
    assert found("from 1,200 to 1500, up 300", "1200 then 1500") == [] and found("up 25%", "1200 then 1500") == [25.0] and found("nothing", "") == []


def test_formats():
    kinds = {"General": "general", "0.00": "number", "0%": "percent", "yyyy-mm-dd": "date", "h:mm": "time", "d/m/yy h:mm": "datetime", "@": "text", "[h]:mm": "time", '"day "0': "number", "mmm-yy": "date", "[$€-407]#,##0": "number", None: "general"}
    assert {c: formats.kind_of_format(c) for c in kinds} == kinds
    cases = [(1234.5, "#,##0.00", "1,234.50"), (-3, "0;(0)", "(3)"), (0.125, "0.0%", "12.5%"), (1500000, '0.0,,"M"', "1.5M"), (12345, "0.00E+00", "1.23E+04"), (0.5, "0.##", "0.5"), (-0.001, "0.0", "0.0"), (7, "000", "007"), (1.5, "General", "1.5"), (1e12, "General", "1E+12"),
             (1, "yyyy-mm-dd", "1900-01-01"), (61, "yyyy-mm-dd", "1900-03-01"), (45292.75, "d mmm yyyy h:mm AM/PM", "1 Jan 2024 6:00 PM"), (1.5, "[h]:mm", "36:00"), (-1, "yyyy", None), (5, '"€"0', "€5"), (0, '0;-0;"nil"', "nil"), (None, "0", None)]
    assert [formats.shown(v, c) for v, c, _ in cases] == [x for *_, x in cases]


def packed(parts):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return held.getvalue()


WORD = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'
PARA = "<w:p><w:pPr>{}</w:pPr><w:r><w:t>{}</w:t></w:r></w:p>"


def test_word_files(spark):
    styles = '<w:styles xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:style w:styleId="A"><w:name w:val="heading 1"/></w:style><w:style w:styleId="B"><w:basedOn w:val="A"/></w:style></w:styles>'
    body = PARA.format('<w:pStyle w:val="B"/>', "Terms") + PARA.format("", "one  two") + PARA.format("<w:numPr/>", "item") + "<w:tbl><w:tr><w:tc>" + PARA.format("", "c1") + "</w:tc><w:tc>" + PARA.format("", "c2") + "</w:tc></w:tr></w:tbl>"
    good = packed({"word/document.xml": WORD.format(body), "word/styles.xml": styles})
    bad = {"t": packed({"word/document.xml": WORD.format("<w:p><w:ins/></w:p>")}), "x": packed({"word/document.xml": "<!DOCTYPE a>" + WORD.format("")}), "m": packed({"word/document.xml": WORD.format(""), "word/vbaProject.bin": ""}), "u": packed({"../a": ""}), "n": b"plain", "e": b"", "l": bytes.fromhex("D0CF11E0A1B11AE1"), "p": packed({"a": ""}), "c": good[: len(good) // 2]}
    rows = office.read_documents(spark.createDataFrame([("good", bytearray(good)), *((k, bytearray(v)) for k, v in bad.items())], "path string, content binary")).collect()
    assert [(r.role, r.level, r.section, r.text, r.col) for r in rows if r.path == "good"] == [("heading", 1, [], "Terms", None), ("paragraph", None, ["Terms"], "one two", None), ("list_item", None, ["Terms"], "item", None), ("cell", None, ["Terms"], "c1", 0), ("cell", None, ["Terms"], "c2", 1)]
    assert {r.path: r.error for r in rows if r.path != "good"} == {"t": "tracked_changes", "x": "external_entity", "m": "macros", "u": "unsafe_name", "n": "not_a_package", "e": "empty", "l": "legacy_or_encrypted", "p": "missing_part", "c": "not_a_package"}


def test_workbooks(spark):
    made = office.workbook_bytes({"One & two": [["a<b", 1, 2.5], [None, "x"]], "Empty": []})
    assert office.workbook_cells(made) == [("One & two", 0, "A1", "text", "a<b", "a<b", None), ("One & two", 0, "B1", "number", "1", "1", None), ("One & two", 0, "C1", "number", "2.5", "2.5", None), ("One & two", 0, "B2", "text", "x", "x", None)]
    with pytest.raises(office.Refused, match="missing_part"):
        office.workbook_cells(packed({"word/document.xml": ""}))


def test_marker():
    near = lambda text, word: marks.marker(text, text.index(word), text.index(word) + len(word))
    assert near("It was £48 before; now £31", "£48") == ("original_price", "was") and near("It was £48 before; now £31", "£31") == ("discount", "now")
    assert near("MRP €640 €515", "€515") is None and near("MRP €640 €515", "€640") == ("original_price", "MRP")
    assert near("know $5 offset", "$5") is None and near("12 USD sale price", "12 USD") == ("discount", "sale price")
    assert near("Was now $5", "now") == ("original_price", "Was") and marks.marker("", 0, 0) is None


def test_changed_window(spark):
    cases = [(["a", "bb", "c", "d"], 2, 3, {"text": "a bb c d", "start": 2, "stop": 6}), (["a", "b"], None, None, {"text": "a b", "start": 0, "stop": 3}), ([], None, None, None), (None, 1, 1, None), (["a", "b", "c"], 3, 9, {"text": "b c", "start": 2, "stop": 3}), (["a"], 5, 6, None)]
    df = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "k int, w array<string>, a int, b int")
    rows = df.select("k", marks.changed_window(F.col("w"), F.col("a"), F.col("b"), 1).alias("x")).withColumn("m", marks.nearest_marker("x")).sort("k").collect()
    assert [r.x and r.x.asDict() for r in rows] == [{"text": "a bb c d", "start": 2, "stop": 6}, *(c[3] for c in cases[1:])]
    assert all(r.m.kind is None for r in rows)


def test_report_blocks(spark):
    feed = "comparison_id int, seq int, change string, kind string, where_old string, where_new string, before string, after string, difference string, evidence_old string, evidence_new string, title string"
    df = spark.createDataFrame([(1, 1, None, None, None, None, '<"&', None, "", None, "q", "clash")], feed)
    names = spark.createDataFrame([(1, "A<B"), (2, None)], "comparison_id int, title string")
    get = lambda html: [r.block for r in exports.report_blocks(df, names, html).sort("comparison_id", "seq").collect()]
    assert get(False) == ["A<B\n1 change", '1.  ()\n   Before: <"&\n   Evidence (revised): "q"', "", "\n0 changes", ""]
    page = get(True)
    assert "<title>A&lt;B</title>" in page[0] and "<dd><del>&lt;&quot;&amp;</del></dd>" in page[1] and page[3].endswith("<h2>0 changes</h2>")
    assert exports.report_blocks(df.where("seq = 5"), names).count() == 4
