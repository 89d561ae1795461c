"""The engine's own operators: every query against its SQL, and what SQL can't say against plain Python."""

import os
import itertools
import random
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text, urls, values
from palimpsest.operators import align, evidence, explain, feed, pages, report, sheets, web, workbooks
from palimpsest.plans import reading, registry, web as web_queries, workbooks as workbook_queries  # noqa: F401  register their queries
from palimpsest.sources import html
from palimpsest.streaming import limits

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df):
    columns = sorted(df.columns)
    show = lambda x: None if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    return columns, sorted((tuple(map(show, r)) for r in df[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    assert plain(registry.QUERIES[name](spark, DATA).toPandas()) == plain(duck.sql(registry.ORACLE_SQL[name]).df())


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first()[0]


def test_text(spark):
    v = F.col("v")
    assert one(spark, text.normalize(v), " “a”  – b​ ") == '"a" - b'
    assert one(spark, text.key(v, ignore_punctuation=True), "Hello, World 1,000.") == "hello world 1,000"
    assert one(spark, text.exact_key(v), "Straße ﬁ") == "strasse fi"
    assert one(spark, text.quoted(v, 10), "alpha beta gamma") == "alpha"
    assert [one(spark, text.is_page_number(v), x) for x in ("7", "Page 2 of 9", "- 3 -", "3/4", "Page two")] == [True] * 4 + [False]
    assert one(spark, text.html_escape(v), "<a&b>") == "&lt;a&amp;b&gt;"


def test_values(spark):
    d = lambda x: one(spark, values.parse_date(F.col("v")).cast("string"), x)
    assert d("due 3rd March 2024") == d("2024-03-03") == d("March 3, 2024") == "{2024-03-03, false}"
    assert d("3/4/2024").endswith("true}") and d("31/2/2024") == "{NULL, NULL}" or "null" in d("31/2/2024").lower()
    num = lambda a, b: one(spark, values.number_delta(F.lit(a).cast("decimal(28,4)"), F.lit(b).cast("decimal(28,4)")))
    assert (num("50000", "75000"), num("0", "5"), num("3", "3"), num("8", "7")) == ("+25000 (+50%)", "+5", None, "-1 (-12.5%)")
    assert one(spark, values.date_delta(F.lit("2024-01-01").cast("date"), F.lit("2024-01-02").cast("date"))) == "1 days later"
    assert [one(spark, values.kind_of(F.col("v")), x) for x in ("5%", "$1,200", "AB-12", "1999", "12", "word")] == ["percent", "money", "identifier", "year", "number", "text"]


def test_urls(spark):
    assert one(spark, urls.strip_tracking(F.col("v")), "https://a.b/c?utm_source=1&q=2&REF=3&TtClid=5#f") == "https://a.b/c?q=2&REF=3#f"
    assert one(spark, urls.strip_tracking(F.col("v")), "https://a.b/cdn-cgi/l/email-protection#a1b2") == "https://a.b/cdn-cgi/l/email-protection"
    why = [one(spark, urls.problem(F.col("v")), x) for x in ("ftp://a", "http://u:p@a", "http://a:99/", "http://10.1.2.3/", "https://a.b/")]
    assert why == ["scheme", "credentials", "port", "address", None]


def test_alignment_holds_every_unit_once(spark):
    r = random.Random(5)
    for _ in range(60):
        old = [" ".join(r.choice("a b c d e".split()) for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 8))]
        new = [x for x in old if r.random() > 0.3] + [r.choice(["x y z", "a b c d"])] * r.randint(0, 2)
        got = align.align_units(old, new)
        assert sorted(i for _, i, _, _ in got if i is not None) == [*range(len(old))]
        assert sorted(j for _, _, j, _ in got if j is not None) == [*range(len(new))]
        assert all(old[i] == new[j] for k, i, j, _ in got if k in ("equal", "moved"))
    a, b = "price: 50 a month", "price: 75 a month"
    assert align.ratio(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio() > 0.8
    assert align.ratio("ab", "ab") == 1 and align.ratio("ab", "ac") == align.ratio("", "") == align.ratio("abcdef", "uvwxyz") == 0
    assert align.align_units(["fee of 50 dollars"], ["fee of 75 dollars"])[0][0] == "modified"
    assert align.word_segments("a b c", "a x c") == [("b", "x")]


def test_alignment_query(spark):
    old = spark.createDataFrame([(1, 0, "same"), (1, 1, "a b c d"), (2, 0, "x")], "scope long, place long, key string")
    new = spark.createDataFrame([(1, 0, "same"), (1, 1, "a b c e"), (2, 0, "x")], "scope long, place long, key string")
    got = {(r.scope, r.kind, tuple((s.old, s.new) for s in r.segments)) for r in align.align(old, new).collect()}
    assert got == {(1, "equal", ()), (1, "modified", (("d", "e"),))}


def test_pages_and_sheets():
    assert pages.longest_chain([0, 3, 1, 2]) == {0, 2, 3}
    r = random.Random(9)
    for _ in range(300):
        places = [(r.randint(0, 5), r.randint(0, 5), r.randint(1, 9) / 10) for _ in range(r.randint(0, 9))]
        weight = lambda ks: sum(places[k][2] for k in ks)  # noqa: B023, E731
        rises = lambda ks: all(places[a][0] < places[b][0] and places[a][1] < places[b][1] for a, b in zip(ks, ks[1:], strict=False))  # noqa: B023, E731
        own = pages.heaviest_chain(places)
        order = sorted(range(len(places)), key=lambda k: places[k])
        every = [ks for n in range(len(places) + 1) for ks in itertools.combinations(order, n) if rises(ks)]
        assert rises(own) and abs(weight(own) - max(map(weight, every))) < 1e-9
    assert sheets.moved_formula('A1+$A$1+"A1"+\'A1 x\'!B2', 1, 1) == 'B2+$A$1+"A1"+\'A1 x\'!C3'
    assert sheets.moved_formula("A1", -1, 0) == "#REF!"


def test_html():
    got = html.parse("<html><nav><p>no</p></nav><article><h1>T</h1><p>one <b>two<p>three<a href='https://x.y'>l</a></article><script>p</script>")
    assert [(u[0], u[3]) for u in got] == [("heading", "T"), ("paragraph", "one two"), ("paragraph", "threel"), ("link", "l")]
    assert got[1][2] == ["T"] and html.parse("") == []
    cells = html.parse("<table><tr><th>a<th>b<tr><td><table><tr><td>x</table><td>y</table><table><td>z</table>")
    assert [(u[3], u[5]) for u in cells] == [("a", (0, 0, 0)), ("b", (0, 0, 1)), ("x", (1, 0, 0)), ("y", (0, 1, 1)), ("z", (2, -1, 0))]
    long = "".join(f"<p>{k}</p>" for k in range(6000)) + "<dl><dt>a<dd>b</dl><p style='visibility: hidden'>c</p>"
    assert len(html.parse(long)) == 6002 and html.parse(long)[-1][:1] == ("paragraph",)
    assert html.parse(long, 10)[-1] == ("warning", None, [], "10 of 6002 units", None, None)


def test_limiter_counts_accepted_hits_only(spark):
    assert limits.accept([0, 1, 2, 3, 11, 12], [(2, 10)])[0] == [True, True, False, False, True, True]
    hits = spark.createDataFrame([(1, k, float(t)) for k, t in enumerate([0, 1, 2, 3, 11])], "key long, id long, t double")
    got = {r.id: r.accepted for r in limits.limited(hits, [(2, 10.0)]).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True}


def test_planted_violations(spark):
    feed = spark.createDataFrame([(1, "added", None, "x"), (2, "removed", "y", None), (3, "modified", "a", None), (4, "added", None, "z")], "change_id long, kind string, old_value string, new_value string")
    claims = spark.createDataFrame([(1, "new"), (2, "new"), (3, "old"), (3, "new"), (9, "old")], "change_id long, side string")
    got = {(r.change_id, r.rule) for r in evidence.violations(feed, claims).collect()}
    assert got == {(2, "sides"), (3, "values"), (4, "sides"), (9, "unknown_change")}


def test_segments(spark):
    marks = F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("stop"), F.lit("a").alias("id")), F.struct(F.lit(4).alias("start"), F.lit(99).alias("stop"), F.lit("b").alias("id")))
    got = spark.range(1).select(report.segments(F.lit(8), marks).alias("s")).first().s
    assert [(x.start, x.stop, x.ids) for x in got] == [(0, 2, []), (2, 4, ["a"]), (4, 5, ["a", "b"]), (5, 8, ["b"])]


def test_matched_pages(spark):
    text = {k: f"alpha{k} beta{k} gamma{k} common" for k in range(6)}
    old = spark.createDataFrame([(1, k, text[k]) for k in range(6)], "scope long, page int, text string")
    new = spark.createDataFrame([(1, n, text[k]) for n, k in enumerate([0, 4, 1, 2, 5])], "scope long, page int, text string")
    got = sorted((r.old_page, r.new_page, r.in_order) for r in pages.matched_pages(old, new, F.split("text", " ")).collect())
    assert got == [(0, 0, True), (1, 2, True), (2, 3, True), (4, 1, False), (5, 4, True)]


def test_daily_budget_is_of_utc_days(spark):
    hits = spark.sql("select id, timestamp_micros(id * 3600000000) t from range(48)")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert [r.id for r in limits.daily_budget(hits, "t", "id", 2).orderBy("id").collect()] == [0, 1, 24, 25]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_evidence_without_an_excerpt(spark):
    claims = spark.sql("select * from values (1, 'new', 5, 'b'), (2, 'new', 5, null), (3, 'new', 6, 'x'), (4, 'new', 5, 'z') t(change_id, side, unit_id, excerpt)")
    units = spark.sql("select 'new' side, 5 unit_id, 'abc' text")
    checked = evidence.verify(claims, units)
    assert {r.change_id: r.issue for r in checked.collect()} == {1: None, 2: "no_excerpt", 3: "unknown_unit", 4: "not_quoted"}
    assert [r.change_id for r in evidence.traceable(claims.select("change_id"), checked).collect()] == [1]


def test_workbook_changes(spark):
    names = "book long, sheet string, sheet_index int, row int, col int, kind string, value string, formula string, link string"
    cell = lambda s, i, r, c, k, v, f=None, a=None: (1, s, i, r, c, k, v, f, a)
    grid = [[f"{x}{r}" for x in "abc"] for r in range(1, 7)]
    old = [cell("S", 0, r, c, "text", v) for r, row in enumerate(grid, 1) for c, v in enumerate(row, 1)]
    old += [cell("S", 0, 1, 4, "percent", "0.1"), cell("S", 0, 2, 4, "number", "5", "A2+1"), cell("S", 0, 3, 4, "date", "45000"), cell("S", 0, 4, 4, "number", "8", "A4+1"), cell("S", 0, 5, 4, "text", "t", None, "https://a.b"), cell("T", 1, 1, 1, "text", "x")]
    # a row comes in on top, the third goes to the end; D has new values
    order = [None, 1, 2, 4, 5, 6, 3]
    new = [cell("S", 1, n, c, "text", (f"{x}{r}" if r else f"new{x}")) for n, r in enumerate(order, 1) for c, x in enumerate("abc", 1)]
    new += [cell("S", 1, 2, 4, "percent", "0.125"), cell("S", 1, 3, 4, "number", "5", "A3+1"), cell("S", 1, 7, 4, "date", "45000"), cell("S", 1, 4, 4, "number", "10", "A4+2"), cell("S", 1, 5, 4, "text", "t", None, "https://a.c"), cell("T", 0, 1, 1, "text", "X")]
    feed = workbooks.compare(spark.createDataFrame(old, names), spark.createDataFrame(new, names), ignore_case=True)
    got = {(r.type, r.sheet, r.old_ref, r.new_ref, r.old_value, r.new_value, r.delta) for r in feed.collect()}
    assert got == {
        ("sheet_moved", "S", None, None, "0", "1", None),
        ("row_added", "S", None, "A1:C1", None, "newa | newb | newc", None),
        ("row_moved", "S", "A3:D3", "A7:D7", "a3 | b3 | c3 | 45000", "a3 | b3 | c3 | 45000", None),
        ("cell_modified", "S", "D1", "D2", "0.1", "0.125", "+2.5 percentage points"),
        ("formula_modified", "S", "D4", "D4", "A4+1", "A4+2", "+2 (+25%)"),
        ("link_modified", "S", "D5", "D5", "https://a.b", "https://a.c", None),
    }
    assert [r.seq for r in feed.orderBy("seq").collect()] == [*range(1, 7)] and {r.group for r in feed.collect()} == {"structure", "values", "formulas", "links"}


def test_web_changes(spark):
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    page = lambda title, h, price, href: f"<html><head><title>{title}</title></head><body><h2>{h}</h2><p>Some words that stay here.</p><h2>Plans</h2><table>{row('plan', 'fee')}{row('basic', '5')}{row('large', price)}</table><p><a href='{href}'>Guide</a></p></body></html>"
    df = lambda x: spark.createDataFrame([(1, "https://a.b/c", x)], "page_id long, url string, html string")
    old, new = page("T", "About us", "9", "https://g.h/1?utm_source=x"), page("U", "The company", "12", "https://g.h/2")
    got = {(r.layer, r.kind, r.label, r.old_value, r.new_value) for r in web.compare(df(old), df(new)).collect()}
    assert got == {("metadata", "modified", "title", "T", "U"), ("heading", "modified", "The company", "About us", "The company"), ("table", "modified", "large · fee", "9", "12"), ("link", "modified", "Guide", "https://g.h/1", "https://g.h/2")}
    same = page("T", "About us", "9", "https://g.h/1")
    assert web.compare(df(old), df(same)).count() == 0


def test_feed(spark):
    rows = [(1, "a", 5, 2, 1, False, "x"), (1, "b", 4, None, 3, None, "y"), (1, "c", 3, None, None, True, "x"), (1, "d", 2, 1, 9, False, None), (2, "a", 1, 2, None, False, "zz")]
    f = spark.createDataFrame(rows, "pair long, id string, seq long, new_page int, old_page int, noise boolean, kind string")
    assert [r.id for r in feed.numbered(f, "pair", feed.reading_order()).where("pair = 1").orderBy("number").collect()] == ["d", "a", "b", "c"]
    assert sorted(map(tuple, feed.counts(f, "pair").collect())) == [(1, 4, 3, 1), (2, 1, 1, 0)]
    assert [tuple(r) for r in feed.counts_in_order(feed.shown(f), "kind", ["y", "none", "x"]).orderBy("place").collect()] == [(1, "y", 1), (2, "none", 0), (3, "x", 1), (4, "other", 1), (5, "zz", 1)]
    assert sorted(map(tuple, feed.affected(f, "pair", pages="new_page").collect())) == [(1, 2), (2, 1)]
    assert [(r.kind, r["rank"]) for r in feed.first_seen(f, "pair", "kind", "seq").where("pair = 1").orderBy("rank").collect()] == [("x", 1), ("y", 2)]
    assert sorted((r.id, r.seq) for r in feed.renumbered(f, "pair", "seq", F.col("id") != "c").where("pair = 1").collect()) == [("a", 3), ("b", 2), ("d", 1)]
    assert [r.id for r in feed.selected(f, "pair", F.col("kind") == "y", feed.reading_order(), 2).where("pair = 1").orderBy("place").collect()] == ["d", "b"]
    notes = spark.createDataFrame([(1, "a"), (2, "a"), (3, "q"), (4, None)], "note int, id string")
    assert {r.note: r.problem for r in feed.attached(notes, f, "id", ["note"]).collect()} == {1: None, 2: "duplicate", 3: "unknown_change", 4: "unknown_change"}
    assert sorted((r.pair, r.id) for r in feed.anchored(f, f.where("id = 'a'"), ["pair", "new_page"], ["pair", "id"], F.col("new_page").isNotNull()).collect()) == [(1, "a"), (2, "a")]
    assert [r.s for r in spark.createDataFrame([("a/b",), ("a/bc",), ("a/b/c",)], "s string").where(feed.within(F.col("s"), "a/b")).collect()] == ["a/b", "a/b/c"]
    none = f.where("false")
    assert feed.numbered(none, "pair", feed.reading_order()).count() == 0 and feed.counts(none, "pair").count() == 0
    assert [tuple(r) for r in feed.withheld(f, "kind", used="seq").orderBy("reason").collect()] == [("given", 1, 2), ("x", 2, 8), ("y", 1, 4), ("zz", 1, 1)]


def walked(old, new, pairs):
    """Page links by walking the pages one after the other; what page_links says in windows."""
    to, used = dict(pairs), {b for _, b in pairs}
    for p in sorted(old):
        if p in to or old[p]:
            continue
        before, after = to.get(p - 1), to.get(p + 1)
        if before and after:
            q = before + 1 if after == before + 2 else None
        else:
            q = before + 1 if before else after - 1 if after else None
        if q in new and q not in used and not new[q]:
            to[p] = q
            used.add(q)
    for p, q in zip([p for p in sorted(old) if p not in to], [q for q in sorted(new) if q not in used]):
        to[p] = q
        used.add(q)
    return sorted([(p, to.get(p, 0)) for p in old] + [(0, q) for q in new if q not in used])


def test_page_links_against_a_walk(spark):
    rng = random.Random(5)
    old, new, pairs, want = [], [], [], []
    for scope in range(150):
        a, b = ({p: rng.random() < 0.4 for p in range(1, rng.randint(1, 9))} for _ in range(2))
        texts = [[p for p, t in side.items() if t] for side in (a, b)]
        n = rng.randint(0, min(map(len, texts)))
        own = list(zip(*(sorted(rng.sample(t, n)) for t in texts)))
        old += [(scope, p, t) for p, t in a.items()]
        new += [(scope, p, t) for p, t in b.items()]
        pairs += [(scope, p, q, True) for p, q in own]
        want += [(scope, p, q) for p, q in walked(a, b, own)]
    side = "scope int, page int, has_text boolean"
    got = pages.page_links(spark.createDataFrame(old, side), spark.createDataFrame(new, side), spark.createDataFrame(pairs, "scope int, old_page int, new_page int, in_order boolean"))
    assert sorted((r.scope, r.old_page or 0, r.new_page or 0) for r in got.collect()) == sorted(want)


def test_moved_pages_and_pages_of_one_side(spark):
    side, pair = "scope int, page int, has_text boolean", "scope int, old_page int, new_page int, in_order boolean"
    got = pages.page_links(spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True)], side), spark.createDataFrame([(1, 1, True), (1, 2, False)], side), spark.createDataFrame([(1, 1, 1, False)], pair))
    assert sorted((r.old_page, r.new_page or 0, r.kind, r.comparable) for r in got.collect()) == [(1, 1, "moved", True), (2, 2, "matched", False), (3, 0, "removed", False)]
    empty = spark.createDataFrame([], side)
    assert pages.page_links(empty, empty, spark.createDataFrame([], pair)).count() == 0


def test_value_delta(spark):
    rows = [("$5", "$10"), ("5%", "10%"), ("$5", "€10"), ("10 days", "30 days"), ("10 days", "3 weeks"), ("3/4/2024", "5 May 2024"), ("AB-12", "AB-13"), (None, "$5"), ("0", "5"), ("2024-01-01", "2024-01-02")]
    df = spark.createDataFrame(rows, "a string, b string").select(values.typed(F.col("a")).alias("a"), values.typed(F.col("b")).alias("b"))
    assert [r[0] for r in df.select(values.value_delta(F.col("a"), F.col("b"))).collect()] == ["+5 (+100%)", "+5", None, None, None, None, None, None, "+5", "1 days later"]


def test_values_are_parsed_once(spark):
    """Each form of a date is looked for once, and a difference is computed once: no pattern stands in the plan again and again."""
    df = spark.createDataFrame([("3rd March 2024", "$5")], "a string, b string")
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().analyzed().toString().lower()
    assert plan(values.parse_date(F.col("a"))).count("regexp_extract") == 4
    assert plan(values.number_delta(F.length("a"), F.length("b"))).count("bround") == 1
    days = ["1 Sept 2024", "31 February 2024", "5 MAY 0050", "May 5th, 2024", "13/1/24", "1.13.1999", "1/2/2024", "2/2/0004", "2024-13-01", "2024-1-31 or 3 May 2020", "45 May 2024 2024-01-02"]
    got = spark.createDataFrame([(x,) for x in days], "v string").select(values.parse_date(F.col("v")).alias("d")).select(F.col("d.date").cast("string"), "d.ambiguous").collect()
    assert [tuple(r) for r in got] == [(None, None), (None, None), ("0050-05-05", False), ("2024-05-05", False), ("2024-01-13", False), ("1999-01-13", False), ("2024-02-01", True), ("2004-02-02", False), (None, None), ("2020-05-03", False), ("2024-01-02", False)]


def test_quotes_and_tokens(spark):
    v = F.col("v")
    assert one(spark, text.rejoined(F.split(v, "[|]")), "an inter-|national well-|Known end-") == "an international well- Known end-"
    assert one(spark, text.cited(F.split(v, " "), 10), "alpha beta gamma") == ("alpha beta", 2)
    assert one(spark, text.cited(F.split(v, " "), 3), "alpha") == ("", 0)
    assert one(spark, text.cited(F.split(v, " "), 10, 1), "a b") == ("a", 1)
    assert sorted(one(spark, text.attribute_tokens(v), "cookie-Banner topNav")) == ["banner", "cookie", "cookiebanner", "nav", "top", "topnav"]
    assert one(spark, text.first_token(v, ["nav", "ad"]), "topNav x_ad") == "ad" and one(spark, text.first_token(v, ["nav"]), "navigate") is None


def test_cell_evidence_of_null_quotes(spark):
    given = spark.createDataFrame([(1, "new", "S", "A1", "f", None), (2, "new", "S", "A1", "f", "…"), (3, "new", "S", "A1", None, "x"), (4, "new", "S", "A1", "f", "lo…")], "change_id int, side string, sheet string, ref string, fingerprint string, excerpt string")
    cells = spark.createDataFrame([("new", "S", "A1", "long")], "side string, sheet string, ref string, text string")
    sheets = spark.createDataFrame([("new", "S", "f")], "side string, sheet string, fingerprint string")
    assert {r.change_id: r.issue for r in evidence.verify_cells(given, cells, sheets).collect()} == {1: "not_quoted", 2: "not_quoted", 3: "other_document", 4: None}


def test_replies(spark):
    said = [(1, '[{"change_id": 1, "statement": "A.", "refs": [1, 9]}, {"change_id": 2, "statement": " a. ", "refs": [2]}, {"change_id": 2, "statement": "A.", "refs": [2]}]'), (2, None), (3, "[]"), (4, '[{"change_id": 1, "statement": "x"}]')]
    got = explain.statements(spark.createDataFrame(said, "batch int, reply string"), spark.createDataFrame([(1, 1), (1, 2), (4, 4)], "batch int, change_id long"))
    assert sorted((r.batch, r.problem or "", r.change_id or 0) for r in got.collect()) == [(1, "", 1), (1, "", 2), (1, "", 2), (2, "unreadable", 0), (4, "unknown_change", 0)]
    facts = spark.createDataFrame([(1, 1), (2, 2), (9, 2)], "ref long, change_id long")
    checked = explain.references(got.where("problem is null").drop("problem"), facts)
    assert sorted((r.change_id, r.place, r.problem or "") for r in checked.collect()) == [(1, 0, "foreign_reference"), (2, 1, ""), (2, 2, "duplicate")]


def test_opaque_links_labels_and_shells(spark):
    pairs = [("http://a/x?s=1&sid=1", "http://a/x?sid=2&s=1#f", True), ("http://a/x?q=a%20b&v=1", "http://a/x?q=a b", True), ("http://a/x?q", "http://a/x?q=&cb=1", True), ("http://a/x?q=1", "http://a/x?q=2&v=1", False), ("http://a/x", "http://a/y?v=1", False), ("http://a/x?v=1", "http://a/x?v=1", False), (None, "http://a/x?v=1", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert [r.got for r in df.select(urls.opaque_difference(F.col("a"), F.col("b")).alias("got")).collect()] == [p[2] for p in pairs]
    v = F.col("v")
    assert [one(spark, values.label_before(v, F.lit("$5")), x) for x in ("Total – $5 off $5", ": $5", "Total: $6", "x" * 81 + " $5")] == ["Total", None, None, None]
    note = lambda page, n: one(spark, html.render_note(v, F.lit(n)), page)
    assert note("<div id=app></div>", 3) == note("<p data-reactroot>a</p>", 1) == note("<main x='1' id='root' y>  </main>", 0) == "needs_javascript"
    assert note("<div id=root>text</div>", 1) is None and note("<p></p>", 0) == "empty_page" and note("<div id=root></div>", 25) is None
