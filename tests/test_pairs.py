"""Typed segments, pairs one to one, likeness of units and sets, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import align, pages, pairing, segments, structure

R = random.Random(11)


def typed(spark, *pairs):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "id int, old_text string, new_text string")
    got = segments.typed(df.withColumn("segments", align.segments("old_text", "new_text"))).orderBy("id", "nth").collect()
    return [(r.id, r.kind, r.category, r.old_value, r.new_value, r.difference) for r in got]


def test_dates_come_first_and_take_their_words(spark):
    got = typed(
        spark,
        ("Valid until 30 June 2026 only.", "Valid until 15 July 2026 only."),  # two words of one date
        ("Valid until 30 June 2026.", "Valid until 30 June 2027."),  # the year alone
        ("It is 30 years. Deadline: 30 September 2026", "It is 31 years. Deadline: 15 October 2026"),  # a number beside a date
        ("From 1 May 2024 to 2 May 2024", "From 3 May 2024 to 4 June 2025"),  # two dates
        ("On 01/02/2026 we met", "On 03/04/2026 we met"),  # could be read in two ways
        ("On 13/02/2026 we met", "On 14/02/2026 we met"),
        ("On 2026-02-31 we met", "On 2026-02-28 we met"),  # no real date on one side
        ("June 5, 2024 is early", "June 5, 2024 is late"),  # the date is the same
        ("costs $5 now", "costs €6 now"),
        ("costs about 5 items", "costs about 7 items"),
        ("same", "same"),
        (None, "all new"),
        ("", ""),
    )
    assert got == [
        (0, "modified", "date", "30 June 2026", "15 July 2026", "15 days later"),
        (1, "modified", "date", "30 June 2026", "30 June 2027", "365 days later"),
        (2, "modified", "date", "30 September 2026", "15 October 2026", "15 days later"),
        (2, "modified", "number", "30", "31", "+1 (+3.33%)"),
        (3, "modified", "date", "1 May 2024", "3 May 2024", "2 days later"),
        (3, "modified", "date", "2 May 2024", "4 June 2025", "398 days later"),
        (4, "modified", "text", "01/02/2026", "03/04/2026", None),
        (5, "modified", "date", "13/02/2026", "14/02/2026", "1 days later"),
        (6, "modified", "text", "2026-02-31", "2026-02-28", None),
        (7, "modified", "text", "early", "late", None),
        (8, "modified", "number", "$5", "€6", None),
        (9, "modified", "number", "5", "7", "+2 (+40%)"),
        (11, "added", "text", None, "all new", None),
    ]


def test_dates_only_of_words_that_can_hold_them(spark):
    """Words that can't begin or end a date are sifted out before runs of words are joined; signs alone may stand at both edges."""
    df = spark.createDataFrame([(1, "paid on ( 3rd March 2024 ) . then"), (2, "until “May 5, 2024”, or so"), (3, "a - 2024-01-31; b"), (4, "3 March then 2024"), (5, "( 1/2/2024 )")], "id int, t string")
    span = segments.date_span(F.split("t", " "), F.lit(0), F.size(F.split("t", " ")))
    got = df.select("id", span.alias("s")).orderBy("id").select("s.first", "s.last", "s.text").collect()
    assert [tuple(r) for r in got] == [(-2, -6, "3rd March 2024"), (-1, -4, "May 5, 2024"), (-2, -3, "2024-01-31"), (None, None, None), (0, -2, "1/2/2024")]
    plan = df.select(span.alias("s"))._jdf.queryExecution().analyzed().toString().lower()
    assert plan.index("rlike") < plan.index("array_join")


def test_typed_of_nothing(spark):
    assert typed(spark) == []


def greedy(pairs):
    used, out = (set(), set()), []
    for scope, i, j, s in sorted(pairs, key=lambda p: (p[0], -p[3], p[1], p[2])):
        if (scope, i) not in used[0] and (scope, j) not in used[1]:
            used[0].add((scope, i))
            used[1].add((scope, j))
            out.append((scope, i, j, s))
    return sorted(out)


@pytest.mark.parametrize("levels", [2, 5, 1000])
def test_one_to_one_is_greedy(spark, levels):
    """Also with many ties, and with a chain in which each pair waits for the one before."""
    pairs = [(s, i, j, R.randint(1, levels) / levels) for s in range(4) for i in range(12) for j in range(10) if R.random() < 0.5]
    pairs += [(9, k // 2, (k + 1) // 2, 1 - k / 50) for k in range(20)]
    df = spark.createDataFrame(pairs, "scope int, i int, j int, s double")
    got = pairing.one_to_one(df, ["scope"], "i", "j", [-F.col("s")])
    assert sorted(tuple(r) for r in got.collect()) == greedy(pairs)


def test_one_to_one_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, None, 2, 0.5), (None, 1, 2, 0.5), (1, 1, 2, None), (1, 3, 2, 0.1)], "scope int, i int, j int, s double")
    assert [(r.i, r.j) for r in pairing.one_to_one(df, ["scope"], "i", "j", [F.col("s").isNull(), -F.col("s")]).collect()] == [(3, 2)]
    assert pairing.one_to_one(df.where("scope = 8"), ["scope"], "i", "j", [-F.col("s")]).count() == 0


def unit():
    return "".join(R.choice("abcde xyz, é日") for _ in range(R.randint(0, 30)))


def test_alike_units_miss_nothing(spark):
    olds = [(s, k, unit()) for s in range(3) for k in range(15)] + [(0, 90, ""), (0, 91, "ab"), (0, 92, None)]
    news = [(s, k, R.choice([t[:-3] + "zz", t[2:], unit(), t])) for s, k, t in olds if t is not None] + [(None, 1, "abc")]
    want = {(s, i, j): align.ratio(a, b) for s, i, a in olds for t, j, b in news if s == t and a and b and align.ratio(a, b) >= 0.55}
    old, new = (spark.createDataFrame(x, "scope int, place int, text string") for x in (olds, news))
    got = {(r.scope, r.old_place, r.new_place): r.ratio for r in pairing.alike_units(old, new, ["scope"]).collect()}
    assert got == want and len(want) > 20
    chosen = sorted((r.scope, r.old_place, r.new_place, r.ratio) for r in pairing.paired_units(old, new, ["scope"], most=None).collect())
    assert chosen == greedy([(*k, v) for k, v in want.items()])
    inline = pairing.paired_units(old.where("scope = 1"), new.where("scope = 1"), ["scope"], most=10).collect()
    assert sorted((r.old_place, r.new_place) for r in inline) == [(k, k) for k in range(15) if (1, k, k) in want]


@pytest.mark.parametrize("least", [0.35, 0.8])
def test_alike_sets_miss_nothing(spark, least):
    """With pages of common words only, empty ones and nulls."""
    words = [f"w{k}" for k in range(14)]
    page = lambda: R.sample(words[:5] if R.random() < 0.4 else words, R.randint(0, 5))
    olds, news = ([(s, k, [*page(), None]) for s in (1, 2) for k in range(40)] for _ in "ab")
    olds += [(1, 77, []), (1, 78, None)]
    old, new = (spark.createDataFrame(x, "scope int, page int, w array<string>") for x in (olds, news))
    jac = lambda a, b: len(a & b) / len(a | b) if a & b else 0
    bag = lambda w: set(w or []) - {None}
    want = {(s, i, j, jac(bag(a), bag(b))) for s, i, a in olds for t, j, b in news if s == t and jac(bag(a), bag(b)) >= least}
    assert {tuple(r) for r in pairing.alike_sets(old, new, "scope", "page", F.col("w"), least).collect()} == want and want


def test_pages_of_common_words_meet_and_moved_ones_are_near_equal(spark):
    every = " ".join(f"common{k}" for k in range(30))
    old = [(1, k, f"{every} own{k}" if k < 60 else f"apart{k} b{k} c{k} d{k} e{k}") for k in range(64)]
    new = [(1, 100, old[63][2]), (1, 101, old[62][2].replace("e62", "x").replace("d62", "y"))] + [(1, k, old[k][2]) for k in range(60)]
    a, b = (spark.createDataFrame(x, "scope int, page int, text string") for x in (old, sorted(new, key=lambda r: (r[1] < 100, r[1]))))
    b = b.withColumn("page", F.when(F.col("page") >= 100, F.col("page") - 200).otherwise(F.col("page")))
    got = {(r.old_page, r.new_page): r.in_order for r in pages.matched_pages(a, b, F.split("text", " ")).collect()}
    assert all(got.get((k, k)) for k in range(60)) and got.pop((63, -100)) is False and (62, -99) not in got and len(got) == 60


def test_paired_tables_are_greedy(spark):
    rows = [(s, i, j, R.choice([0.2, 0.3, 0.5, 0.7])) for s in range(6) for i in range(6) for j in range(5)]
    want = []
    for s in range(6):
        own = sorted((r for r in rows if r[0] == s and r[3] >= 0.3), key=lambda r: (-r[3], abs(r[1] - r[2]), r[1], r[2]))
        a, b = set(), set()
        for _, i, j, v in own:
            if i not in a and j not in b:
                a.add(i), b.add(j), want.append((s, i, j, v))
    got = structure.paired_tables(spark.createDataFrame(rows, "scope long, old long, new long, overlap double"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_histogram_counts_every_sign(spark):
    t = "Hello, World! 日本 007"
    got = spark.createDataFrame([(t.lower(),)], "t string").select(pairing.histogram(F.col("t")).alias("h")).first().h
    assert sum(got) == len(t) and got[pairing.LETTERS.index("l")] == 3 and got[-1] == len(re.sub("[ a-z0-9]", "", t.lower()))
