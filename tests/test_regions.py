"""Scores and regions of random pages, against sums over the tree that they were made of."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import regions
from palimpsest.sources import html

R = random.Random(21)


class Node:
    def __init__(self, tag, parts, role=""):
        self.tag, self.parts, self.role = tag, parts, role

    def markup(self):
        inner = "".join(p if isinstance(p, str) else p.markup() for p in self.parts)
        return f"<{self.tag}{f' role={self.role}' if self.role else ''}>{inner}</{self.tag}>"

    def content(self):
        return "".join(p if isinstance(p, str) else p.content() for p in self.parts)

    def all(self):
        return [self, *(x for p in self.parts if isinstance(p, Node) for x in p.all())]

    def length(self):
        return len(" ".join(self.content().split()))

    def score(self):
        n = self.length()
        links = sum(x.length() for x in self.all() if x.tag == "a")
        return n * (1 - min(links / n, 1)) + 40.0 * sum(x.tag == "p" for x in self.all()) if n else 0.0


def made(depth=0):
    tags = ["div", "section", "span", "b", "article"] if depth < 4 else ["span", "a", "p"]
    texts = ["a", " b c ", "", " ", "word\n", "日本 x", "end."]
    parts = [R.choice(texts) if R.random() < 0.5 or depth > 4 else made(depth + 1) for _ in range(R.randint(0, 4))]
    tag = R.choice(tags)
    if tag in ("a", "p"):
        parts = [p for p in parts if isinstance(p, str)]
    return Node(tag, parts, "main" if R.random() < 0.03 else "")


def region_of(body):
    every = body.all()
    depth = {}

    def walk(n, d):
        depth[id(n)] = d
        for p in n.parts:
            if isinstance(p, Node):
                walk(p, d + 1)

    walk(body, 0)
    mains = [x for x in every if x.tag == "main" or x.role == "main"]
    if mains:
        return every.index(mains[0]), "main_element"
    articles = [x for x in every if x.tag == "article"]
    if articles:
        return every.index(max(articles, key=lambda x: (x.score(), -every.index(x)))), "article_element"
    own = [x for x in every if x.tag in regions.SCORABLE and x.score() > 0]
    best = max((x.score() for x in own), default=0)
    if own and best >= body.score() * 0.6:
        return every.index(min((x for x in own if x.score() >= best * 0.999), key=lambda x: (-depth[id(x)], every.index(x)))), "scored_region"
    return 0, "body_fallback"


@pytest.fixture(scope="module")
def bodies():
    out = [Node("body", [made() for _ in range(R.randint(0, 5))]) for _ in range(60)]
    for b in out[::3]:  # without what would decide before the scores do
        for x in b.all():
            x.role, x.tag = "", "div" if x.tag == "article" else x.tag
    return out


@pytest.fixture(scope="module")
def scored(spark, bodies):
    pages = spark.createDataFrame([(k, "<html><head><title>t</title></head>" + b.markup()) for k, b in enumerate(bodies)] + [(900, ""), (901, None)], "page_id long, html string").repartition(3)
    return regions.scores(html.elements(pages)).cache()


def test_scores(scored, bodies):
    got = {}
    for r in scored.where("tag <> 'html'").orderBy("page_id", "node").collect():
        got.setdefault(r.page_id, []).append((r.tag, r.text_length, round(r.score, 6)))
    assert got == {k: [(x.tag, x.length(), round(x.score(), 6)) for x in b.all()] for k, b in enumerate(bodies)}


def test_regions(scored, bodies):
    rank = {}
    for r in scored.where("tag <> 'html'").orderBy("page_id", "node").collect():
        rank.setdefault(r.page_id, []).append(r.node)
    got = {r.page_id: (rank[r.page_id].index(r.node), r.strategy) for r in regions.main_region(scored).collect()}
    assert got == {k: region_of(b) for k, b in enumerate(bodies)} and {s for _, s in got.values()} >= {"article_element", "scored_region", "body_fallback"}


def test_furniture_that_is_content_stays(spark):
    page = "<body><article><header>x</header><nav><p>" + "menu " * 30 + "</p><aside>in it</aside></nav><div class='promo box'><nav>y</nav></div><p>" + "text " * 20 + "</p></article><footer>out</footer></body>"
    s = regions.scores(html.elements(spark.createDataFrame([(1, page)], "page_id long, html string")))
    got = sorted((r.reason, r.kept) for r in regions.furniture(s, regions.main_region(s), ["promo"]).collect())
    assert got == [("aside", False), ("header", False), ("nav", True), ("noise:promo", False)]


def test_plan_has_no_range_join(scored):
    plan = regions.main_region(scored)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_pages(spark):
    none = html.elements(spark.createDataFrame([], "page_id long, html string"))
    assert regions.main_region(regions.scores(none)).count() == 0 and regions.scores(none.where(F.lit(False))).columns[-1] == "score"
