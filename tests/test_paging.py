"""Pages from break events, against a walk over them."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import paging
from palimpsest.sources import office

R = random.Random(5)
DDL = "scope long, pos long, unit string, kind string, words int, row long, cell long"


def walk(events):
    """(page, counts) of each event, and the last page, by a state that goes from event to event."""
    page, seen, hard = 1, False, False
    out, row, cell, began, ends = [], None, None, None, []
    for kind, words, r, c in [*((e[3], e[4] or 0, e[5], e[6]) for e in events), (None, 0, None, None)]:
        if row is not None and (r != row or c != cell):
            ends.append((page, seen, hard))
            page, seen, hard = began if r == row else max(ends, key=lambda s: s[0])
        if r is not None and r != row:
            began = (page, seen, hard)
            ends = [began]
        row, cell = r, c
        counts = kind == "hard" or (kind == "rendered" and not hard) or (kind == "before" and r is None and seen)
        out.append((page, counts))
        page += counts
        if kind == "hard" or (kind == "before" and counts):
            hard = True
        elif kind == "object" or (kind == "text" and words):
            seen, hard = True, False
    return out[:-1], page


def walked(events):
    """Units and extent of a document."""
    steps, last = walk(events)
    units = {}
    for e, (page, counts) in zip(events, steps, strict=True):
        u = units.setdefault(e[2], {"page": None, "words": 0, "breaks": []})
        if e[3] == "text" and e[4] and u["page"] is None:
            u["page"] = page
        if e[3] in ("hard", "rendered") and counts:
            u["breaks"].append(u["words"])
        u["words"] += e[4] or 0
    return {k: (u["page"], [b for b in u["breaks"] if 0 < b < u["words"]]) for k, u in units.items() if k is not None and u["words"]}, last


def made(scope, n):
    out, pos, row = [], R.randint(-3, 3), 0
    kinds = ["text", "text", "hard", "rendered", "rendered", "object", "other"]
    one = lambda unit, kind, r=None, c=None: out.append((scope, pos + len(out) * 2, unit, kind, R.choice([0, 1, 2, 5, None]) if kind == "text" else None, r, c))
    for k in range(n):
        if R.random() < 0.4:
            row += 1
            for c in range(R.randint(1, 3)):
                for _ in range(R.randint(1, 4)):
                    one(f"r{row}c{c}", R.choice(kinds), row, c)
        else:
            if R.random() < 0.3:
                one(f"p{k}", "before")
            for _ in range(R.randint(1, 4)):
                one(f"p{k}", R.choice(kinds))
    return out


@pytest.fixture(scope="module")
def documents():
    return {s: made(s, R.randint(1, 12)) for s in range(1, 400)}


def test_events_units_and_extents(spark, documents):
    rows = [e for d in documents.values() for e in d]
    R.shuffle(rows)
    at = paging.numbered(spark.createDataFrame([*rows, (None, 1, "x", "text", 3, None, None), (7, None, "x", "text", 3, None, None)], DDL).withColumn("page", F.lit("theirs"))).persist()
    got = {(r.scope, r.pos): (r.page, r.counts) for r in at.collect()}
    assert at.count() == len(rows) and got == {(s, e[1]): x for s, d in documents.items() for e, x in zip(d, walk(d)[0], strict=True)}
    units = {(r.scope, r.unit): (r.page, list(r.breaks)) for r in paging.units(at).collect()}
    assert units == {(s, u): x for s, d in documents.items() for u, x in walked(d)[0].items()}
    assert any(x for _, x in units.values())
    ends = {r.scope: (r.words, r.pages) for r in paging.extents(at).collect()}
    assert ends == {s: (sum(e[4] or 0 for e in d), max(walked(d)[1], 1)) for s, d in documents.items()}


def test_a_row_may_turn_the_bit_over(spark):
    """The second cell reaches as far as the first only after a hard break; what counts after the row hangs on that."""
    def doc(scope, first):
        kinds = [(first, None, None), ("text", 1, 0), ("hard", 1, 0), ("text", 1, 0), ("rendered", 1, 1), ("hard", 1, 1), ("rendered", None, None), ("text", None, None)]
        return [(scope, i, f"u{i}", k, 1 if k == "text" else None, r, c) for i, (k, r, c) in enumerate(kinds)]

    docs = {1: doc(1, "hard"), 2: doc(2, "text")}
    got = {(r.scope, r.pos): (r.page, r.counts) for r in paging.numbered(spark.createDataFrame([e for d in docs.values() for e in d], DDL)).collect()}
    assert got == {(s, e[1]): x for s, d in docs.items() for e, x in zip(d, walk(d)[0], strict=True)}
    assert got[1, 6] == (3, True) and got[2, 6] == (3, False)


def test_trust(spark):
    rows = [(1, 100, 3, 3, 100), (2, 100, 3, 3, 115), (3, 100, 3, 3, 116), (4, 100, 3, 2, 100), (5, 100, 3, None, 100), (6, 100, 3, 0, 100), (7, 100, 3, 3, None), (8, 0, 1, 1, 0), (9, 5, 1, 1, 0), (10, 5, 1, 1, 15), (11, 70, 1, 1, 80), (12, 70, 1, 1, 81)]
    extent = spark.createDataFrame([(r[0], r[1], r[2]) for r in [*rows, (13, 9, 9)]], "scope long, words long, pages long")
    stored = spark.createDataFrame([(r[0], r[3], r[4]) for r in rows], "scope long, stored_pages int, stored_words int")
    got = {r.scope: r.reason for r in paging.trusted(extent, stored).collect()}
    none, old = "no_statistics", "statistics_out_of_date"
    assert got == {1: None, 2: None, 3: old, 4: "pages_disagree", 5: none, 6: none, 7: none, 8: "empty", 9: old, 10: None, 11: None, 12: old, 13: none}


def test_nothing(spark):
    at = paging.numbered(spark.createDataFrame([], DDL))
    assert paging.units(at).count() == 0 and paging.extents(at).count() == 0


def word_file(body, app=""):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        if app:
            z.writestr("docProps/app.xml", f'<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/extended-properties">{app}</Properties>')
    return held.getvalue()


def test_word_files(spark):
    t = lambda x: f'<w:r><w:t xml:space="preserve">{x}</w:t></w:r>'
    soft, hard = "<w:r><w:lastRenderedPageBreak/></w:r>", '<w:r><w:br w:type="page"/></w:r>'
    p = lambda *x, pr="": f"<w:p>{pr}{''.join(x)}</w:p>"
    start = "<w:pPr><w:pageBreakBefore/></w:pPr>"
    tc = lambda *x: f"<w:tc>{p(*x)}</w:tc>"
    body = "".join([
        p(t("one tw"), soft, t("o three"), pr=start),  # nothing before it: no new page; the break falls in the second word
        p(hard, soft, t("four"), pr="<w:pPr><w:pageBreakBefore w:val='0'/></w:pPr>"),
        f"<w:tbl><w:tr>{tc(t('five '), soft, t('six'))}{tc(soft, t('seven'))}{tc(t('eight'))}</w:tr><w:tr>{tc(t('nine'))}</w:tr></w:tbl>",
        p("<w:r><w:rPr><w:vanish/></w:rPr><w:t>not read</w:t></w:r>", t("ten"), pr=start),
    ])
    files = [("a", word_file(body, "<Pages>5</Pages><Words>10</Words>")), ("b", word_file(p(t("x")), "<Pages>two</Pages>")), ("c", b"no file"), ("d", None), ("e", word_file(""))]
    files = spark.createDataFrame(files, "path string, content binary")
    events = office.read_page_events(files)
    assert {(r.scope, r.error) for r in events.where("error is not null").collect()} == {("c", "not_a_package"), ("d", "empty")}
    at = paging.numbered(events)
    assert {(r.scope, r.unit): (r.page, list(r.breaks)) for r in paging.units(at).collect()} == {("a", "0"): (1, [2]), ("a", "1"): (3, []), ("a", "2/0/0"): (3, [1]), ("a", "2/0/1"): (4, []), ("a", "2/0/2"): (3, []), ("a", "2/1/0"): (4, []), ("a", "3"): (5, []), ("b", "0"): (1, [])}
    said = {r.scope: (r.words, r.pages, r.status, r.reason) for r in paging.trusted(paging.extents(at), office.read_statistics(files)).collect()}
    assert said == {"a": (10, 5, "recorded", None), "b": (1, 1, "unavailable", "no_statistics")}
