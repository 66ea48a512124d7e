"""Template deduction against a plain version, and pages whose names mislead."""

from itertools import combinations

import pytest

from textpace.llm import html_templates as H

STORY = "<h1>Title {i}</h1><p>" + "A long story {i}. " * 8 + "</p>"


def extract(spark, sources):
    table = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(sources)], "page_id long, url string, html string")
    return [r["text"] for r in H.extract(table).orderBy("page_id").collect()]


def story(i):
    return f"Title {i}\n\n" + " ".join([f"A long story {i}."] * 8)


def test_names_do_not_empty_articles(spark):
    """A wrapper whose name tells of the layout keeps its story; furniture beside and inside it goes."""
    wrappers = ['div class="content no-sidebar"', 'div class="page with-header"', 'div class="main-widget"',
                'div class="share-price"', 'div class="post-content has-sidebar"', 'div class="notice-of-motion"', "form",
                'article class="post"']
    inner = ('<section class="related-work"><p>Work {i}</p></section><div id="notice-period"><p>Period {i}</p></div>'
             '<div class="share-buttons">Share {i}</div><div class="post-comments"><p>Reader {i}</p></div>')
    sources = [(f"http://w{k}.example/{i}", f'<body><nav>Menu {i}</nav><{w}>{(STORY + inner).format(i=i)}</{w.split()[0]}>'
                                           f'<div class="site-footer">Foot {i}</div></body>')
               for k, w in enumerate(wrappers) for i in range(3)]
    got = extract(spark, sources)
    assert got == [f"{story(i)}\n\nWork {i}\n\nPeriod {i}" for _ in wrappers for i in range(3)]


def test_pages_without_an_article_stay_empty(spark):
    pages = ["<nav>Menu</nav><div class='ad'>Buy now</div>", "<form><input></form>", "<footer>Foot</footer>"]
    assert extract(spark, [(f"http://e{k}.example/", p) for k, p in enumerate(pages)]) == [""] * 3


def plain_template(pages):
    """Valid classes of one host's token lists, with whole vectors and every pair of classes."""
    tokens = {t for p in pages for t in p}
    vectors = {}
    for t in tokens:
        vector = tuple(p.count(t) for p in pages)
        if set(vector) <= {0, 1} and sum(vector) >= H.SUPPORT * len(pages):
            vectors.setdefault(vector, []).append(t)
    classes = []
    for vector, members in vectors.items():
        orders = {tuple(t for t in p if t in members) for p, n in zip(pages, vector) if n}
        if len(members) >= H.CLASS_TOKENS:
            classes.append((sum(vector), members, orders))
    crossed = set()
    for a, b in combinations(range(len(classes)), 2):
        for p in pages:
            at = [[p.index(t) for t in classes[k][1]] if classes[k][1][0] in p else [] for k in (a, b)]
            if all(at):
                inside = [{sum(x < y for x in sorted(at[1 - s])) for y in at[s]} for s in (0, 1)]
                if len(inside[0]) > 1 and len(inside[1]) > 1:
                    crossed.add(max((a, b), key=lambda k: (-classes[k][0], min(classes[k][1]))))
    steady = [[same.pop() for same in map(set, zip(*orders)) if len(same) == 1] for _, _, orders in classes]
    return sorted(c for k, c in enumerate(steady) if len(c) >= H.CLASS_TOKENS and k not in crossed)


def test_templates_against_a_plain_version(spark):
    """Classes with equal vectors, one order, nested: blocks that swap places or stand twice are no template."""
    def page(i):
        parts = [f"<div class=a><div class=b>{i}</div></div>", "<div class=same>fixed line</div>"]
        if i % 4:
            parts.append("<section class=opt><div class=in>now and then</div></section>")
        parts += ["<ul class=x>x</ul>", "<ol class=y>y</ol>"][::1 if i % 2 else -1]
        parts += [f"<table class=rows>{k}</table>" for k in range(i % 3)]
        return "<html><body>" + "".join(parts) + "</body></html>"

    hosts = {"one.example": [page(i) for i in range(8)], "two.example": [page(5)] * 4,
             "flat.example": [f"<body><p>{i}</p>" for i in range(3)]}
    table = spark.createDataFrame([(h, p) for h, ps in hosts.items() for p in ps], "host string, html string")
    got = {r["_host"]: r for r in H.templates(table).collect()}
    for host, pages in hosts.items():
        assert [list(c) for c in got[host]["_classes"]] == plain_template([H.Page(p).tokens for p in pages])
    one = [H.main_text(p, got["one.example"]["_classes"], got["one.example"]["_constant"]) for p in hosts["one.example"]]
    assert all("fixed line" not in t and "now and then" not in t for t in one)
    assert [t.split("\n\n")[0] for t in one] == [str(i) for i in range(8)]


@pytest.mark.parametrize("tokens, bad", [([2, 4, 6, 8], []), ([2, 6, 8, 4], []), ([2, 6, 4, 8], [6])])
def test_crossing_classes(tokens, bad):
    classes = [{"tokens": [2, 4], "pages": 5}, {"tokens": [6, 8], "pages": 4}]
    assert [c for c, _, x in H.order_on_page(tokens, classes) if x] == bad


def test_slots_nest():
    assert H.slots_of([10, 20, 30, 40, 50], [[10, 40, 50], [20, 30]]) == [0, 10, 20, 10, 40, 50]
    assert H.slots_of([7, 8], []) == [0, 0, 0]


@pytest.mark.parametrize("name, inside, mark", [
    ("ad-box", False, H.STRONG), ("sidebar", True, H.STRONG), ("postComments", False, H.STRONG), ("main-widget", False, H.WEAK),
    ("no-sidebar", False, 0), ("share-price", False, 0), ("header", True, 0), ("site-header", False, H.STRONG), ("story", False, 0)])
def test_name_marks(name, inside, mark):
    assert H._name_mark(name, inside) == mark
