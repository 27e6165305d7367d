"""Main text by wrapper induction: odd markup, names of classes, layouts, partitions; alignment against brute force."""

import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from groupstats.llm.dom import describe, parse
from groupstats.llm.wrappers import extract, main_text, match_trees


def alone(source):
    return main_text(describe(parse(source)), set(), set())


@pytest.mark.parametrize(
    "source, text",
    [
        ("<div class='has-sidebar'><article>body text</article></div>", "body text"),
        ("<div id='content-with-sidebar'><p>body text</p></div>", "body text"),
        (
            "<article><h1 class='article-header'>A</h1><p class='side-note'>B</p><div class='share-price'>C</div><p>rest</p></article>",
            "A\nB\nC\nrest",
        ),
        ("<form action=x><article>body</article></form>", "body"),
        ("<p>body text of the page</p><form>your name</form>", "body text of the page"),
        ("<article>the text itself<div class='sidebar'>x</div><div class='top-menu'>y</div></article>", "the text itself"),
        ("<article>short<ol class='commentlist'><li><article class='comment'>a much longer reply</article></ol></article>", "short"),
        ("<b>" * 5000 + "deep", "deep"),
        ("<b>" * 5000 + "</i>" * 5000 + "deep", "deep"),
        ("", ""),
    ],
)
def test_names_support_but_do_not_decide(source, text):
    assert alone(source) == text


def test_deep_trees_align():
    a, b = parse("<b>" * 5000 + "x"), parse("<b>" * 4000 + "<i>y</i>" + "<b>" * 3000)
    describe(a), describe(b)
    assert len(match_trees(a, b)) == 4001 + 1000


def test_alignment_is_the_largest_by_brute_force():
    draw = random.Random(3)

    def grow(depth):
        tag = draw.choice("bi")
        inner = "".join(grow(depth - 1) for _ in range(draw.randint(0, 3))) if depth else ""
        return f"<{tag}>{inner}</{tag}>"

    @lru_cache(maxsize=None)
    def best(x, y):
        if x.tag != y.tag:
            return 0
        return 1 + best_row(tuple(x.children), tuple(y.children))

    @lru_cache(maxsize=None)
    def best_row(p, q):
        if not p or not q:
            return 0
        return max(best_row(p[1:], q), best_row(p, q[1:]), best(p[0], q[0]) + best_row(p[1:], q[1:]))

    for _ in range(60):
        a, b = parse(grow(3)), parse(grow(3))
        describe(a), describe(b)
        pairs = match_trees(a, b)
        # runs of one shape are matched in order, which may lose against the best alignment but never beats it
        assert len(pairs) <= best(a, b)
        assert all(x.tag == y.tag for x, y in pairs)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
        same = parse("<b><i></i><b></b></b>"), parse("<b><i></i><b></b></b>")
        describe(same[0]), describe(same[1])
        assert len(match_trees(*same)) == best(*same)


def page(k, layout):
    words = " ".join(f"w{k * 31 + j}" for j in range(20))
    if layout == 0:
        return f"<body><div class='one'><p>Welcome to the first kind</p><p>{words}</p></div></body>"
    return f"<body><section class='two'><div class='q'>Notice of the second kind</div><div class='r'>{words} tail</div></section></body>"


def test_two_layouts_of_a_host_and_any_partitions(spark):
    rows = [(k, "http://a.example/", page(k, k % 3 == 0), k) for k in range(60)]
    rows += [(k % 7, "http://a.example/", page(0, 1), k) for k in range(200)]  # copies are one witness
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _layout long")
    seen = []
    for parts in (1, 9):
        made = extract(df.repartition(parts, F.rand(parts)))
        assert set(made.columns) == {"page_id", "url", "_layout", "text"}
        seen.append(sorted(map(tuple, made.select("page_id", "_layout", "text").collect())))
    assert seen[0] == seen[1]
    texts = {text for _, _, text in seen[0]}
    assert not any("kind" in t for t in texts)
    assert all(" ".join(f"w{k * 31 + j}" for j in range(20)) + (" tail" if k % 3 == 0 else "") in texts for k in range(60))
