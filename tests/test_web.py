"""Markup blocks, links and office rows on small literal inputs."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from textpace.functions import web as H
from textpace.operators import markup as K
from textpace.operators import office as O
from textpace.operators import packages as P


def page_blocks(spark, html):
    rows = K.blocks(spark.createDataFrame([(1, html)], "page_id INT, html STRING")).orderBy("block_idx").collect()
    return [(r.type, r.text, r.payload) for r in rows]


def test_blocks(spark):
    html = ("<div>a <b>b</b> c</div><section>x <i>y</i> z<p>p<p>q</section><ol><li>1<li>2<ul><li>in</li></ul></li></ol>"
            "<ul><li></li></ul><blockquote><p>s</p><p>t</p></blockquote><pre><code class='language-JS'>a  b</code></pre>"
            "<img src='a.gif'><img src='b.png' height='1'><img src='c.png' alt='C'><math><annotation encoding='application/x-tex'>"
            "x_1</annotation></math><table><tr><td>1</td></tr></table>end")
    assert page_blocks(spark, html) == [
        ("paragraph", "a b c", None), ("paragraph", "x", None), ("paragraph", "y", None), ("paragraph", "z", None),
        ("paragraph", "p", None), ("paragraph", "q", None), ("list", "1. 1", None), ("list", "2. 2in", None), ("list", "•", None),
        ("quote", "st", None), ("code", "code", "a  b"), ("image", "image", "c.png"), ("formula", "formula", "x_1"),
        ("table", "table", "<table><tr><td>1</td></tr></table>"), ("paragraph", "end", None)]


def test_resolve_url_follows_the_standard(spark):
    base = "https://h.org/a/b/c.html?q=1#f"
    refs = ["x.png", "./y", "../z?k=1", "/root", "//cdn.org/p", "https://o.org/", "?n=2", "#top", "", "../../../up", "d/", ".."]
    df = spark.createDataFrame([(r,) for r in refs], "r STRING").select("r", H.resolve_url(F.col("r"), F.lit(base)).alias("u"))
    got = {r.r: r.u for r in df.collect()}
    want = {r: urljoin(base, r) for r in refs}
    want[""] = "https://h.org/a/b/c.html?q=1"
    assert got == want


def test_main_container(spark):
    words = "word, " * 80
    html = f"<body><div class='menu'><a>{words}</a></div><article class='post'><p>{words}</p><p>{words}</p></article></body>"
    row = K.main_container(spark.createDataFrame([(1, html)], "page_id INT, html STRING")).first()
    assert row.tag == "article"


def test_validation_reasons(spark):
    cases = {"": "empty", "example.org/x": None, "ftp://a.b": "unsupported_scheme", "file:///x": "local_file", "http://1.2.3.4/": "ip_address",
             "localhost": "local_file", "https://nodot": "invalid_format", "https://a..b": "suspicious", "https:///p": "missing_host"}
    df = spark.createDataFrame([(c,) for c in cases], "u STRING").select("u", H.validate_url(F.col("u"))["reason"].alias("r"))
    assert {r.u: r.r for r in df.collect()} == cases


def test_ebook(spark):
    xml = ("<FictionBook><description><title-info><author><first-name>A</first-name></author><book-title>T &amp; U</book-title>"
           "</title-info></description><body><section><title><p>One</p><p>Two</p></title><epigraph><p>e</p><text-author>w</text-author>"
           "</epigraph><section><title><p>Deep</p></title><p>x <b>y</b></p><v>v1</v></section></section></body><binary>zz</binary></FictionBook>")
    df = spark.createDataFrame([(1, xml)], "doc_id INT, xml STRING")
    rows = P.ebook_blocks(df).orderBy("block_idx").collect()
    assert [(r.type, r.level, r.text) for r in rows] == [
        ("heading", 1, "OneTwo"), ("quote", None, "e"), ("paragraph", None, "w"), ("heading", 2, "Deep"),
        ("paragraph", None, "x y"), ("paragraph", None, "v1")]
    assert tuple(P.ebook_metadata(df).select("title", "author").first()) == ("T & U", "A")


def test_code_paragraphs_merge(spark):
    paras = spark.createDataFrame([(1, i, "Normal", None, "paragraph", None) for i in range(4)],
                                  "doc_id INT, para_idx INT, style_id STRING, num_level INT, type STRING, level INT")
    runs = spark.createDataFrame(
        [(1, 0, 0, "a", ["Courier"]), (1, 1, 0, "b", ["Menlo"]), (1, 1, 1, " ", ["Arial"]), (1, 2, 0, "c", ["Menlo", "Arial"]), (1, 3, 0, "d", ["Monaco"])],
        "doc_id INT, para_idx INT, run_idx INT, text STRING, fonts ARRAY<STRING>")
    rows = O.paragraph_blocks(paras, runs).orderBy("block_idx").collect()
    assert [(r.type, r.text, r.payload) for r in rows] == [("code", "code", "a\nb"), ("paragraph", "c", None), ("code", "code", "d")]


def test_images_in_text(spark):
    html = ("<p>text <img src='a.png'> more</p><h2>t <img src='b.png'></h2><div>one <img src='c.png'> two</div>"
            "<figure><img src='d.png'><img src='e.png'></figure>")
    assert page_blocks(spark, html) == [
        ("paragraph", "text more", None), ("heading", "t", None), ("paragraph", "one", None), ("image", "image", "c.png"),
        ("paragraph", "two", None), ("image", "image", "d.png")]
