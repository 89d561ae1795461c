"""Web pages: units of broken markup, and all layers of a comparison, case by case."""

import pytest

from palimpsest.operators import web
from palimpsest.sources import html


def units(page, **k):
    return [(u[0], u[3]) for u in html.parse(page, **k)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<ul><li hidden>a<li>b</ul><p>d</p><p>e</p>", [("list_item", "b"), ("paragraph", "d"), ("paragraph", "e")]),  # a hidden element without an end
        ("<div style='display: none'><p>x</div><p>y", [("paragraph", "y")]),
        ("<li>foo <div>bar</div> baz</li>", [("list_item", "foo bar baz")]),
        ("<table><tr><td><p>x</p><p>y</p></td></table>", [("table_cell", "x y")]),
        ("<blockquote><p>a<p>b</blockquote><p>c", [("quote", "a b"), ("paragraph", "c")]),
        ("<dl><dt>a<dd>b<dt>c</dl>d", [("paragraph", "a"), ("paragraph", "b"), ("paragraph", "c")]),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", [("list_item", "a b c"), ("list_item", "d")]),
        ("<p>a<ul><li>b</ul></p>", [("paragraph", "a"), ("list_item", "b")]),
        ("<p>a</div>b<p>c</span></section>d", [("paragraph", "ab"), ("paragraph", "cd")]),  # ends without a beginning
        ("<nav>x<p>no</nav><p>yes</p><svg><path/><p>no</svg><p>too", [("paragraph", "yes"), ("paragraph", "too")]),
        ("<h2>a<h3>b</h3>", [("heading", "a"), ("heading", "b")]),
        ("<p>a<br>b<hr>c", [("paragraph", "a b")]),
        ("", []),
    ],
)
def test_units_of_broken_pages(page, want):
    assert units(page) == want


def test_loose_text_is_asked_for():
    page = "<head><title>no</title></head><body>zero<div>Price is $5</div><p>a</p>tail <b>more</b><ul>x<li>y</ul></body>"
    assert units(page) == [("paragraph", "a"), ("list_item", "y")]
    assert units(page, loose=True) == [("text", "zero"), ("text", "Price is $5"), ("paragraph", "a"), ("text", "tail more"), ("text", "x"), ("list_item", "y")]


def test_links_are_resolved():
    got = html.parse("<p><a href='/b'>b</a><a href='?q=1'>q</a><a href='mailto:x@y'>m</a><a href='http://[bad'>z</a><a>n</a></p>", base="https://h.i/a/c")
    assert [u[3:5] for u in got if u[0] == "link"] == [("b", "https://h.i/b"), ("q", "https://h.i/a/c?q=1")]


def feed(spark, old, new, url="https://a.b/c"):
    df = lambda x: spark.createDataFrame([(1, url, x)] if x is not None else [], "page_id long, url string, html string")
    return sorted(((r.layer, r.kind, r.category, r.label, r.old_value, r.new_value, r.difference, r.noise) for r in web.compare(df(old), df(new)).collect()), key=str)


def table(*rows, cell="td"):
    return "<table>" + "".join("<tr>" + "".join(f"<{cell if k == 0 else 'td'}>{c}" for c in row) for k, row in enumerate(rows)) + "</table>"


def test_tables_without_heads_lose_nothing(spark):
    got = feed(spark, table(["Basic", "$10"], ["Pro", "$20"]), table(["Basic", "$12"], ["Pro", "$25"]))
    assert got == [("table", "modified", "number", "Basic", "$10", "$12", "+2 (+20%)", None), ("table", "modified", "number", "Pro", "$20", "$25", "+5 (+25%)", None)]


def test_columns_pair_by_head_then_by_place(spark):
    old, new = table(["Plan", "Fee", "Seats"], ["Pro", "9", "1"], cell="th"), table(["Plan", "Users", "Fee", "Note"], ["Pro", "2", "8", "x"], cell="th")
    got = feed(spark, old, new)
    assert ("table", "modified", "number", "Pro · Fee", "9", "8", "-1 (-11.11%)", None) in got  # by head
    assert ("table", "removed", "table", "Seats", "Seats · 1", None, None, None) in got and ("table", "added", "table", "Users", None, "Users · 2", None, None) in got
    assert ("table", "added", "table", "Note", None, "Note · x", None, None) in got and len(got) == 4
    got = feed(spark, table(["Plan", "Seats"], ["Pro", "1"], cell="th"), table(["Plan", "Users"], ["Pro", "2"], cell="th"))
    assert got == [("table", "modified", "number", "Pro · Users", "1", "2", "+1 (+100%)", None), ("table", "modified", "table", "Plan", "Seats", "Users", None, None)]


def test_rows_come_and_go(spark):
    got = feed(spark, table(["a", "1"], ["b", "2"]), table(["c", "3"], ["a", "1"]))
    assert got == [("table", "added", "table", "c", None, "c · 3", None, None), ("table", "removed", "table", "b", "b · 2", None, None, None)]
    assert feed(spark, table(["a", "1"]), "") == [("table", "removed", "table", "a", "a · 1", None, None, None)]


def test_reworded_links_are_pairs(spark):
    old, new = ("<p>" + "".join(f"<a href='{h}'>{x}</a>" for x, h in links) + "</p>" for links in ([("Start now", "https://x.y/1"), ("Help", "https://x.y/h"), ("Gone", "https://x.y/g")], [("Start here now", "https://x.y/2"), ("Help", "https://x.y/h?utm_source=q")]))
    got = [r for r in feed(spark, old, new) if r[0] == "link"]
    assert got == [("link", "modified", "link", "Start here now", "https://x.y/1", "https://x.y/2", None, None), ("link", "removed", "link", "Gone", "https://x.y/g", None, None, None)]


def test_metadata_in_any_markup(spark):
    old, new = "<html lang=en><head><meta content='a &amp; b' name='description'><link href=https://c.d rel=canonical></head>", '<html lang="de"><head><meta name="description" content="it\'s"></head>'
    assert feed(spark, old, new) == [("metadata", "modified", "text", "description", "a & b", "it's", None, None), ("metadata", "modified", "text", "lang", "en", "de", None, None), ("metadata", "removed", "text", "canonical", "https://c.d", None, None, None)]


def test_blocks_give_typed_changes(spark):
    old, new = "<h1>Fees</h1><p>Pay $5 by 30 June 2026 at our desk.</p><div>Open until 5</div>", "<h1>Fees</h1><p>Pay $6 by 15 July 2026 at our desk.</p><div>Open until 6</div>"
    assert feed(spark, old, new) == [
        ("block", "modified", "date", "Fees", "30 June 2026", "15 July 2026", "15 days later", None),
        ("block", "modified", "number", "Fees", "$5", "$6", "+1 (+20%)", None),
        ("block", "modified", "number", "Fees", "5", "6", "+1 (+20%)", None),
    ]


def test_pages_of_one_side(spark):
    assert feed(spark, "<p>x", None) == [("page", "removed", "text", "https://a.b/c", "https://a.b/c", None, None, None)]
    assert feed(spark, None, "<p>x") == [("page", "added", "text", "https://a.b/c", None, "https://a.b/c", None, None)]
    assert feed(spark, None, None) == []
    assert feed(spark, None, "") == [("page", "added", "text", "https://a.b/c", None, "https://a.b/c", None, None)]


def test_pages_are_dealt_to_all_tasks(spark, monkeypatch):
    """A table may be one file: its pages are dealt out by number before they are read."""
    seen, own = [], web.html.units
    monkeypatch.setattr(web.html, "units", lambda df, **how: seen.append(df) or own(df, **how))
    side = lambda words: spark.createDataFrame([(k, "https://a.example/", f"<article><p>{words} {k}</p></article>") for k in range(3)], "page_id long, url string, html string").coalesce(1)
    assert web.compare(side("one small page"), side("one large page")).count() == 3
    assert len(seen) == 2 and all("RepartitionByExpression [page_id" in df._jdf.queryExecution().analyzed().toString() for df in seen)
