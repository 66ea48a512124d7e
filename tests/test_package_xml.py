"""Members of word-processor and e-book packages on small literal documents."""

import random

from pyspark.sql import functions as F

from textpace.functions import web as H
from textpace.functions import words as W
from textpace.functions import xml as X
from textpace.operators import office as O
from textpace.operators import office_xml as OX
from textpace.operators import packages as P


def members(spark, rows, key="doc_id"):
    return spark.createDataFrame(rows, f"{key} INT, path STRING, content STRING")


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tokens_names_attributes_and_references(spark):
    text = "<a:B x='1>2' n:y=\"&#x41;&#66;&quot;\"/>t &lt;<![CDATA[<z>&amp;]]><!-- <c> --></a:B><"
    row = spark.createDataFrame([(text,)], "t STRING").select(X.tokens(F.col("t")).alias("k")).select(
        F.transform("k", X.local_name).alias("names"), F.transform("k", X.text_of).alias("texts"),
        X.attribute(F.col("k")[0], "x").alias("x"), X.attribute(F.col("k")[0], "y").alias("y"),
        X.attribute(F.col("k")[0], "z").alias("z")).first()
    assert row.names == ["b", None, None, None, "b", None]
    assert row.texts == [None, "t <", "<z>&amp;", None, None, None]
    assert (row.x, row.y, row.z) == ("1>2", 'AB"', None)


def test_references_that_name_no_character_stay(spark):
    got = spark.createDataFrame([("&#0; &#xD800; &#x110000; &#128512; &amp;lt; &nbsp; &",)], "t STRING").select(X.decode(F.col("t"))).first()[0]
    assert got == "&#0; &#xD800; &#x110000; \U0001F600 &lt; &nbsp; &"


BODY = """<w:document><w:body><w:p/>
<w:p><w:pPr><w:numPr><w:ilvl w:val="2"/></w:numPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p>
<w:p><w:pPr><w:pStyle w:val="Quote"/></w:pPr><w:r><w:t>before </w:t></w:r><m:oMath><m:r><m:t>x</m:t></m:r></m:oMath><w:r><w:t> after</w:t></w:r></w:p>
<w:p><w:r><a:blip r:embed="r1"/><w:t>kept</w:t><a:blip r:embed="r2"/></w:r><w:r><w:t> whole</w:t><w:br/></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc><w:tc/></w:tr>
<w:tr><w:tc><w:p><w:r><w:t>d</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:tbl><w:tr><w:tc><w:p><m:oMath><m:t>y</m:t></m:oMath></w:p></w:tc></w:tr></w:tbl>
<w:p><w:r><w:rPr><w:rFonts w:ascii="Menlo" w:hAnsi='"Monaco"'/></w:rPr><w:t>code</w:t></w:r></w:p></w:body></w:document>"""


def test_body(spark):
    rels = "<Relationships><Relationship Id='r1' Target='no.png'/><Relationship Target='./media/i.png' Id='r1'/><Relationship Id='r2' Target='media/gone.png'/></Relationships>"
    t = OX.read_documents(members(spark, [
        (1, "word/document.xml", BODY), (1, "word/_rels/document.xml.rels", rels), (1, "word/media/i.png", None),
        (2, "word/document.xml", ""), (3, "word/document.xml", None), (4, "word/document.xml", "<w:body><w:p><w:r><w:t>open &amp; cut")]))
    blocks = O.paragraph_blocks(O.style_types(t["paras"], t["styles"]), t["runs"])
    assert rows_of(blocks, "doc_id", "block_idx", "type", "text", "payload") == [
        (1, 0, "list", "    • one two", None), (1, 1, "quote", "before", None), (1, 2, "paragraph", "after", None),
        (1, 3, "paragraph", "kept whole", None), (1, 4, "code", "code", "code"), (4, 0, "paragraph", "open & cut", None)]
    assert rows_of(O.embedded_images(t["uses"], t["rels"], t["media"]), "doc_id", "rel_id", "path") == [(1, "r1", "media/i.png")]
    assert rows_of(t["cells"], "table_idx", "row_idx", "cell_idx", "text") == [
        (0, 0, 0, "a b c"), (0, 0, 1, ""), (0, 1, 0, "d"), (1, 0, 0, "in"), (2, 0, 0, "y")]


def test_styles_and_notes_take_the_last_of_an_id(spark):
    m = members(spark, [
        (1, "word/styles.xml", "<w:styles><w:name w:val='out'/><w:style w:styleId='A'><w:name w:val='x'/><w:name w:val='Title'/></w:style>"
                               "<w:style w:styleId='B'/><w:style><w:name w:val='no id'/></w:style></w:styles>"),
        (1, "word/footnotes.xml", "<w:footnotes><w:footnote w:id='2'><w:p><w:t>old</w:t></w:p></w:footnote>"
                                  "<w:footnote w:id='2'><w:t>new</w:t><w:t> one</w:t>x</w:footnote><w:footnote w:id='3'/></w:footnotes>")])
    assert rows_of(OX.styles(m), "style_id", "style_name") == [("A", "Title")]
    assert rows_of(OX.notes(m), "note_id", "text") == [("2", "new one")]


def test_package_documents(spark):
    opf = ("<package><metadata><dc:title>First</dc:title><dc:title> </dc:title></metadata><manifest><item id='a' href='no.x'/>"
           "<item id='a' href='a%20b.x'/><item href='no id'/><!--<item id='c' href='c'/>--><item id='n1' href='n1.x' media-type='application/x-dtbncx+xml'/>"
           "<item id='n2' href='n2.x' media-type='application/x-dtbncx+xml'/></manifest><spine><itemref idref='a'/><itemref idref='c'/><itemref idref='a'/></spine></package>")
    m = members(spark, [
        (1, "META-INF/container.xml", "<rootfile full-path='d/e.opf'/>"), (1, "d/e.opf", opf), (1, "d/a b.x", "A"), (1, "d/n1.x", "N1"), (1, "d/n2.x", "N2"),
        (2, "META-INF/container.xml", "<rootfile/>"), (3, "META-INF/container.xml", "<rootfile full-path='gone'/>"), (4, "META-INF/container.xml", None)],
        "pkg_id")
    documents = P.package_documents(m)
    manifest = P.manifest_items(documents)
    assert rows_of(P.reading_order(P.spine_items(documents), manifest, m), "pkg_id", "spine_idx", "path", "content") == [
        (1, 0, "d/a b.x", "A"), (1, 2, "d/a b.x", "A")]
    assert rows_of(P.package_titles(documents), "pkg_id", "title", "author") == [(1, "First", None)]
    found = P.navigation_members(documents, manifest, m)
    assert found["navs"].count() == 0 and rows_of(found["ncxs"], "pkg_id", "folder", "content") == [(1, "d", "N1")]


def test_words_before_anchors_equal_prefixes_read_anew(spark):
    rng = random.Random(5)
    bits = ["one ", "tw", "o", " ", "3", ".", "5 ", "x&nbsp;y", "$", "\u2003z", "it-", "'s", "http://a ", "&amp;", ", "]
    files, prefixes = [], {}
    for n in range(40):
        pieces = [rng.choice(bits) if rng.random() < 0.6 else (f"a{i}",) for i in range(rng.randrange(60))]
        if rng.random() < 0.5:
            pieces += pieces[:10]
        html = "".join(f"<i id='{p[0]}'></i>" if isinstance(p, tuple) else f"<b>{p}</b>" for p in pieces)
        files.append((n, f"<html><body>{html}</body></html>"))
        for i, p in enumerate(pieces):
            if isinstance(p, tuple):
                prefixes.setdefault((n, p[0]), "".join(q for q in pieces[:i] if isinstance(q, str)))
    df = spark.createDataFrame(files, "f INT, content STRING")
    # Each whole prefix is read anew.
    read = spark.createDataFrame([(*k, t) for k, t in prefixes.items()], "f INT, anchor STRING, t STRING").select(
        "f", "anchor", W.word_count(H.decode_entities(F.col("t"))).alias("n"))
    want = {(r.f, r.anchor): r.n for r in read.collect()}
    got = {(r.f, r.anchor): r.offset for r in P.anchor_offsets(df, ["f"]).collect()}
    assert got == want and len(got) > 300
