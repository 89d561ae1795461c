"""Queries against their SQL on tables that are larger, or odder, than those of the test data, and the steps that were made to grow with their input."""

import difflib
import random

import duckdb
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import align, evidence, layout, pairing, sheets, views
from palimpsest.plans import blocks, documents, reading, registry, web  # noqa: F401  register their queries


def both(spark, folder, name, **tables):
    """Sorted rows of a query and of its SQL over these tables."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = registry.QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, want))


def test_differences_below_zero_are_as_in_sql(spark, tmp_path):
    row = lambda k, size, price: (k, "a", "Brand#1", "t", size, price)
    part = spark.createDataFrame([row(13, 9, 900.5), row(1_000_013, 40, 1000.0), row(26, 50, 1.25), row(1_000_026, 2, 2.25), row(7, 3, 5.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    got, want = both(spark, tmp_path, "cell_changes", part=part)
    assert got == want and any("'+-31'" in r for r in got)


def test_letters_past_three_places(spark, tmp_path):
    n = [1, 26, 27, 702, 703, 16_384, 18_278, 18_279, 18_954, 18_955, 60_000, 140_000, 475_254, 475_255, 2_958_465, 2_958_466, 12_356_630]
    df = spark.createDataFrame([(k,) for k in n], "s_suppkey long")
    own = df.select("s_suppkey", sheets.column_letters(F.col("s_suppkey")).alias("l")).withColumn("back", sheets.column_number(F.col("l"))).collect()
    assert [r.back for r in own] == n and {r.s_suppkey: r.l for r in own}[18_279] == "AAAA" and {r.s_suppkey: r.l for r in own}[475_254] == "ZZZZ"
    got, want = both(spark, tmp_path, "sheet_references", supplier=df)
    assert got == want


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_words_of_units_are_not_shuffled(spark):
    conf = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        units = spark.createDataFrame([(1, 1, "a b, c"), (1, 2, "")], "scope long, unit long, text string")
        cited = spark.createDataFrame([(1, 1, 1, [0, 1]), (1, 2, 1, [2, 2]), (1, 3, 1, [None]), (1, 4, 1, [0, 3]), (1, 5, 1, None), (1, 6, 2, [0]), (1, 1, 1, [2])], "scope long, change long, unit long, tokens array<int>")
        marks = views.marks(cited, units)
        assert exchanges(views.tokens(units)) == 0 and exchanges(marks) <= 2
        assert sorted(map(tuple, marks.collect())) == [(1, 1, 1, 0, 6), (1, 2, 1, 5, 6), (1, 3, 1, 0, 6), (1, 4, 1, 0, 6), (1, 5, 1, 0, 6), (1, 6, 2, 0, 0)]
        spans = spark.createDataFrame([(1, 1, 0, 9), (1, 1, 2, 3), (1, 1, 5, 6), (2, 1, 0, 1)], "scope long, unit long, start int, stop int")
        assert [tuple(r) for r in views.merged(spans, units, ["scope", "unit"]).collect()] == [(1, 1, 0, 9)] and exchanges(views.merged(spans, units, ["scope", "unit"])) <= 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", conf)


def test_units_with_better_partners_are_not_measured(spark, monkeypatch):
    """Equal texts pair by place without a measure, and of a large region only tiles meet; the choice is that of all pairs."""
    rows = [(1, k, f"{'cold hot old new'.split()[k % 4]} plate {k // 3 * 7919}") for k in range(700)]
    edited = [(s, k, t if k % 3 else f"{t} revised") for s, k, t in rows]
    old, new = (spark.createDataFrame(x, "scope long, place long, text string") for x in (rows, edited))
    tiles = pairing.alike_units(old, new, ["scope"], 0.9)
    scored = [(a[1], b[1], pairing.align.ratio(a[2], b[2])) for a in rows[:60] for b in edited[:60]]
    few = lambda df: df.where("place < 60")
    assert sorted((r.old_place, r.new_place, r.ratio) for r in pairing.alike_units(few(old), few(new), ["scope"]).collect()) == sorted(x for x in scored if x[2] >= 0.55)
    assert "Join" not in tiles._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    got, left, right = [], set(), set()
    for i, j, r in sorted((x for x in scored if x[2] >= 0.55), key=lambda x: (-x[2], x[0], x[1])):
        if i not in left and j not in right:
            left.add(i), right.add(j), got.append((i, j, r))
    assert sorted((r.old_place, r.new_place, r.ratio) for r in pairing.paired_units(few(old), few(new), ["scope"], most=None).collect()) == sorted(got)
    asked = []
    monkeypatch.setattr(pairing, "alike_units", lambda a, b, *x, own=pairing.alike_units: asked.append((a.count(), b.count())) or own(a, b, *x))
    assert pairing.paired_units(old, new, ["scope"], most=None).count() == 700 and asked and all(a <= 234 and b <= 234 for a, b in asked)


def test_long_and_odd_texts_are_bounded_from_above():
    texts = ["", "ab", "a" * 70, "é日本語" * 30, "the quick brown fox " * 4, "the quick brown fox", "the brown quick fox!", "\ud800x y", "日本"]
    for least in (0.55, 0.8):
        want = [(i, j, pairing.align.ratio(a, b)) for i, a in enumerate(texts) for j, b in enumerate(texts) if pairing.align.ratio(a, b) >= least]
        assert [x for x in pairing._met(texts, texts, least)] == want


def test_scopes_are_rows_and_only_likely_pairs_are_measured(spark, monkeypatch):
    rows = [(s, k, f"line {k} of document {s}, {'long ' * (k % 5)}") for s in range(4) for k in range(40)]
    edited = [(s, k, t if s == 3 else f"{t} indeed") for s, k, t in rows if k % 11 != 10 or s == 3]
    old, new = (spark.createDataFrame(x, "scope long, place long, text string") for x in ([*rows, (None, 1, "x")], edited))
    got = align.align(old, new)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 2
    assert sorted((r.scope, r.old_place, r.new_place, r.kind) for r in got.collect() if r.old_place is not None and r.kind != "removed") == [(s, k, k, "modified") for s, k, _ in edited if s < 3]
    asked = []
    monkeypatch.setattr(align, "ratio", lambda a, b, own=align.ratio: asked.append(1) or own(a, b))
    texts = [f"{'x y z w v'.split()[k % 5] * (k + 5)} {k}" for k in range(30)]
    assert len(align.best_first(texts, [f"{t} indeed" for t in texts])) >= 25 and len(asked) < 100


def test_ratios_are_those_of_the_standard_library():
    r = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(r.choices("ab cé日", k=r.randint(3, 40))) for _ in "ab")
        want = difflib.SequenceMatcher(None, a, b, autojunk=False)
        assert align.matched(a, b) == sum(m.size for m in want.get_matching_blocks())
        assert align.ratio(a, b) == (want.ratio() if min(want.real_quick_ratio(), want.quick_ratio()) >= 0.55 else 0.0)
        assert align.common(a, b) >= align.matched(a, b)


def test_evidence_meets_the_words_of_its_page_in_one_row(spark):
    conf = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        documents = spark.createDataFrame([(1, "new", "f")], "scope long, side string, fingerprint string")
        pages = spark.createDataFrame([(1, "new", 1, 60.0, 80.0)], "scope long, side string, page int, width double, height double")
        words = spark.createDataFrame([(1, "new", 1, "w0", "one"), (1, "new", 1, "w1", "two"), (1, "new", 1, "w2", None), (1, "new", 1, None, "x")], "scope long, side string, page int, word string, text string")
        rows = [(1, n, 0, "new", "f", 1 if n < 4 else 2, w, None, "one  two") for n, w in enumerate([["w0", None, "w1"], ["w1", "w0"], ["w2", "w9", "w0"], None, ["w7"]])]
        cited = spark.createDataFrame(rows, "scope long, change_id long, nth int, side string, fingerprint string, page int, words array<string>, box struct<x0: double, y0: double, x1: double, y1: double>, excerpt string")
        found = evidence.page_issues(cited, documents, pages, words)
        assert exchanges(found) <= 6
        assert sorted((r.change_id, r.issue, r.word or "") for r in found.collect()) == [(1, "not_quoted", ""), (2, "no_word", "w2"), (2, "no_word", "w9"), (4, "no_page", "")]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", conf)


def test_links_and_blocks_are_shuffled_once(spark):
    """Beginnings of paths and words of texts are no rows; paths without a block keep their links, equal places end together."""
    conf = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        deep = " > ".join(f"d{k}" for k in range(50))
        blocks = spark.createDataFrame([(1, "b1", "d0 > d1", "one two three"), (1, "b2", "d0", "lost"), (1, None, f"{deep} > x", "lost"), (2, "b1", "d0", " one  two"), (None, "b1", "d0", "one")], "scope long, block string, path string, text string")
        links = spark.createDataFrame([(1, "l2", 9, f"{deep} > y", "three"), (1, "l1", 3, deep, "one\ttwo"), (1, "l3", 4, f"{deep} > x > y", "lost"), (2, "l1", 5, "d0", "one"), (2, "l2", 5, "d0 > b", "two"), (2, None, 6, "d0", "x"), (None, "l1", 1, "d0", "one")], "scope long, link string, place int, path string, text string")
        held = views.link_blocks(links, blocks)
        cited = spark.createDataFrame([(1, 1, "b1", [2, 2]), (1, 2, "b1", [1]), (2, 1, "b1", [1])], "scope long, change long, block string, tokens array<int>")
        found = views.link_holding(cited, held)
        plan = held._jdf.queryExecution().executedPlan().toString()
        assert exchanges(held) <= 2 and exchanges(found) <= 4 and "Generate" not in plan and "Window" not in plan
        assert sorted(map(tuple, held.collect())) == [(1, "b1", "l1", 3, 0, 2), (1, "b1", "l2", 9, 2, 3), (2, "b1", "l1", 5, 1, 2), (2, "b1", "l2", 5, 1, 2)]
        assert sorted((r.scope, r.change, r.link) for r in found.collect()) == [(1, 1, "l2"), (1, 2, "l1"), (2, 1, "l2")]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", conf)


def test_sets_of_words_are_shuffled_once(spark):
    conf = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(1, p, [f"w{p % 5}", f"x{p % 3}", "the", None, "the"]) for p in range(40)] + [(2, 0, []), (None, 1, ["the"]), (2, 1, None)]
        df = spark.createDataFrame(rows, "scope long, page long, w array<string>")
        got = pairing.alike_sets(df, df, "scope", "page", F.col("w"), 0.5)
        assert exchanges(got) <= 2
        sets = {(s, p): {x for x in w if x} for s, p, w in rows if s and w}
        want = [(a[0], a[1], b[1], len(x & y) / len(x | y)) for a, x in sets.items() for b, y in sets.items() if a[0] == b[0] and len(x & y) / len(x | y) >= 0.5]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", conf)


def test_pages_are_rows_and_no_groups_of_python(spark):
    words = spark.createDataFrame([(1, 0, 0, k, f"t{k}", 10.0 * (9 - k), 12.0 * (k % 3), 12.0 * (k % 3) + 10, 10.0, k != 4) for k in range(9)], "scope long, page long, column int, word long, text string, x0 double, y0 double, y1 double, size double, bold boolean")
    got = layout.lines(words)
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.line, r.text, r.bold) for r in got.collect()) == [(0, "t6 t3 t0", True), (1, "t7 t4 t1", False), (2, "t8 t5 t2", True)]


def test_dated_lines_shuffles_whole_texts_once(spark, tmp_path):
    """Both versions are one row, pairs bring their texts; rows that share a number, or have none or no text, as in SQL."""
    rows = [(k, f"one {k}\n two\n\n two\nthree", "en") for k in range(24)] + [(5, "another\ntext", "en"), (5, "another\ntext", "en"), (6, None, "en"), (100, None, "en"), (101, "", "en"), (None, "x", "en")]
    got, want = both(spark, tmp_path, "dated_lines", documents=spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got == want and got
    conf = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = registry.QUERIES["dated_lines"](spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert exchanges(found) == 1 and "Join" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", conf)


def test_equal_ends_are_not_aligned(spark, monkeypatch):
    """What is left out of the alignment makes no difference to it, whatever repeats; only what lies between equal ends reaches Python."""
    r = random.Random(5)
    rows = []
    for s in range(1500):
        pool = [*"abcdefghijklmnop"][: r.choice([2, 3, 5, 16])] + r.choice([[], [" a", "A", "a b", "‘b’", None]])
        old = r.choices(pool, k=r.randint(0, 7))
        new = list(old)
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(new))
            new[at : at + r.randint(0, 2)] = r.choices([*pool, "new", "other"], k=r.randint(0, 2))
        rows.append((s, old, new))
    rows += [(9000, [*(f"line {k}" for k in range(50)), "it costs 5 now", "last"], [*(f"line {k}" for k in range(50)), "it costs 7 now", "last"]), (9001, None, ["a"]), (9002, ["a"], None), (9003, None, None), (None, ["a"], ["b"])]
    held = []
    monkeypatch.setattr(align, "_aligned", lambda df, changed, own=align._aligned: held.append(df) or own(df, changed))
    df = spark.createDataFrame(rows, "scope long, old array<string>, new array<string>")
    units = lambda c: F.transform(c, lambda t, n: F.struct((n * 10).cast("long").alias("p"), t.alias("t"))).alias(c)
    got = sorted(map(repr, ((x.scope, x.kind, x.old_place, x.new_place, x.ratio, x.old_text, x.new_text, [tuple(s)[:2] for s in x.segments]) for x in align.changes(df.select("scope", units("old"), units("new"))).collect())))
    plain = lambda t: None if t is None else " ".join(t.translate(str.maketrans("‘’", "''")).split())
    want = []
    for s, old, new in rows:
        a, b = ([plain(t) for t in side or []] for side in (old, new))
        for kind, i, j, ratio in align.align_units(*([None if t is None else t.lower() for t in side] for side in (a, b))) if s is not None else []:
            if kind != "equal":
                want.append((s, kind, None if i is None else i * 10, None if j is None else j * 10, ratio, None if i is None else a[i], None if j is None else b[j], align.word_segments(a[i], b[j]) if kind == "modified" else []))
    assert got == sorted(map(repr, want)) and len(want) > 500
    assert [tuple(x) for x in held[0].where("scope = 9000").select(F.size("_old"), F.size("_new"), F.col("_old.p")).collect()] == [(1, 1, [500])]
    cut = {x.scope: x.n for x in held[0].select("scope", F.size("_old").alias("n")).collect()}
    assert sum(cut[s] < len(old) for s, old, _ in rows[:1500]) > 500 and any(cut[s] == len(old) > 0 and old != new for s, old, new in rows[:1500])


def test_one_pair_is_measured_at_once(monkeypatch):
    asked = []
    monkeypatch.setattr(align, "common", lambda a, b, own=align.common: asked.append(1) or own(a, b))
    assert align.best_first(["it costs 5 now"], ["it costs 7 now"]) == [(0, 0, align.ratio("it costs 5 now", "it costs 7 now"))] and not asked
    assert [align.best_first([a], [b]) for a, b in ((None, None), (None, "abc"), ("", ""), ("abc", "xyz"), ("ab", "ab"))] == [[], [], [], [], [(0, 0, 1.0)]]


def test_texts_with_nothing_to_unify_are_normal(spark):
    odd = [" a", "a ", "a  b", "", " ", "\ta", None, "😀", "a b"]
    signs = spark.range(0x10000).where("id not between 55296 and 57343").select(F.concat(F.lit("a"), F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE"), F.lit("b")).alias("t"))
    every = signs.union(spark.createDataFrame([(t,) for t in odd], "t string"))
    assert every.where(~text.as_normalized(F.col("t")).eqNullSafe(text.normalize(F.col("t")))).count() == 0
    assert every.where(~F.col("t").rlike(text.NOT_PLAIN)).count() > 50_000


def test_large_regions_pair_as_small_ones_do(monkeypatch):
    """A region of over 10,000 pairs whose units change places: each finds its partner, wherever that stands; ties, repeats and short texts as in small regions."""
    old = [f"{'red green blue'.split()[k % 3]} plate number {k * 7919}" for k in range(110)]
    new = [f"{t} revised" for t in reversed(old)]
    assert {(kind, i, j) for kind, i, j, _ in align.align_units(old, new)} == {("modified", k, 109 - k) for k in range(110)}
    r = random.Random(4)
    sides = []
    for _ in range(150):
        pool = ["".join(r.choices("abc é", k=r.randint(0, 9))) for _ in range(r.choice([3, 10, 40]))] + [None, "ab", "abc"]
        sides.append((r.choices(pool, k=r.randint(2, 40)), r.choices([*pool, "cab bac", "ba"], k=r.randint(2, 40))))
    want = [align.best_first(*x) for x in sides]
    monkeypatch.setattr(align, "PAIR_CAP", 0)
    assert [align.best_first(*x) for x in sides] == want


def test_pages_of_words_are_never_shuffled(spark, tmp_path):
    """Lines and blocks come from pages that are rows; only documents that share a number are put together. Odd boxes, sizes and weights as in the forms on lines."""
    r = random.Random(8)
    rows = [(s, p, k, r.choice(["a", "b c", "", None]), x := r.choice([0.0, 50.0, 60.0, 200.0, 201.5]), x + r.choice([0.0, 40.0, 60.0]), y := r.choice([0.0, 3.0, 6.0, 12.0, 30.0, 61.0]), y + r.choice([0.0, 10.0, 14.0]), r.choice([10.0, 14.0, 0.0, None]), r.choice([True, False, None])) for s in range(30) for p in range(2) for k in range(r.choice([1, 5, 12, 40]))]
    words = spark.createDataFrame(rows, "scope long, page long, word long, text string, x0 double, x1 double, y0 double, y1 double, size double, bold boolean")
    pages = words.groupBy("scope", "page").agg(F.collect_list(F.struct("word", "text", "x0", "x1", "y0", "y1", "size", "bold")).alias("words"))
    found = layout.page_lines(pages)
    assert {x.column for x in found.collect()} == {0, 1}
    want = sorted(map(repr, map(tuple, layout.block_rows(layout.blocks(found)).select("scope", "page", "block", "n_lines", "n_words", "_size", "_bold").collect())))
    assert sorted(map(repr, map(tuple, layout.page_blocks(pages).collect()))) == want
    assert sorted(map(tuple, layout.body_sizes(pages).collect())) == sorted(map(tuple, words.where("size > 0").groupBy("scope").agg(F.median("size")).collect()))
    text = " ".join(f"w{k}" for k in range(500))
    once = [(k, text) for k in range(40)] + [(40, None), (41, ""), (None, "x y")]
    for n, docs in enumerate((once, [*once, (5, "one two"), (None, "z")])):
        spark.createDataFrame(docs, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/{n}/documents.parquet")
    assert exchanges(documents.page_lines(spark, f"{tmp_path}/0")) == 0
    got = {(x.scope, x.page, x.line): x.text for x in documents.page_lines(spark, f"{tmp_path}/1").where("column = 0").collect()}
    assert got[5, 0, 0] == "one w0 two w1 w2" and got[6, 0, 0] == "w0 w1 w2" and got[None, 0, 0] == "x z y" and len({s for s, _, _ in got}) == 41
