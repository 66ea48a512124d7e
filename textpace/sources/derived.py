"""Inputs derived from the event, conversation, document and page tables.

Each mirrors one definition in ``textpace/plans/inputs_sql.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textpace.operators.ordered import by_key
from textpace.sources.tables import table


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions_from(table(spark, sf_dir, "events"))


def sessions_from(ev: DataFrame) -> DataFrame:
    """Finished reading sessions, one per event."""
    e = F.col("event_id")
    return ev.select(
        "event_id", "user_id", F.col("ts").alias("finished_at"),
        F.col("value").alias("reading_time_seconds"),
        (F.lit(100) + (e % 19) * 50).cast("int").alias("configured_wpm"),
        F.floor(F.col("value") * (1 + e % 9)).cast("int").alias("total_words"),
        F.when(e % 4 == 0, "Text").when(e % 4 == 1, "URL").when(e % 4 == 2, "File")
        .otherwise("Area").alias("source"),
    )


def control_events_from(ev: DataFrame) -> DataFrame:
    """Player actions."""
    t = F.col("event_type")
    return ev.select(
        "event_id", "user_id", "ts",
        F.when(t == "view", "play").when(t == "click", "pause").when(t == "signup", "seek")
        .when(t == "error", "close").when(t == "purchase", "finish").alias("action"),
        F.col("value").cast("int").alias("word_idx"),
        F.when(F.col("event_id") % 4 == 0, "Text").when(F.col("event_id") % 4 == 1, "URL")
        .when(F.col("event_id") % 4 == 2, "File").otherwise("Area").alias("source"),
    )


def control_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control_events_from(table(spark, sf_dir, "events"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved word positions; the document count is a scalar subquery."""
    n_docs = table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", (F.col("event_id") % n_docs).alias("doc_id"),
        F.floor("value").cast("int").alias("word_idx"), "ts",
    )


def conv_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed blocks: one document per conversation, one block per turn."""
    turn = F.col("turn")
    kind = F.when(turn % 4 == 0, "heading").when(turn % 7 == 5, "code").otherwise("paragraph")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), turn.alias("block_idx"), kind.alias("type"),
        F.when(kind == "heading", 1 + (F.col("conv_id") + turn) % 3).cast("int").alias("level"),
        F.when(kind == "code", F.lit("code")).otherwise(F.col("text")).alias("text"),
        F.when(kind == "code", F.col("text")).alias("payload"),
    )


def rich_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of nine kinds with payloads, some of them blank, from conversations."""
    c, t = F.col("conv_id"), F.col("turn")
    n = (c * 7 + t) % 9
    kind = (
        F.when(n == 0, "heading").when(n == 1, "code").when(n == 2, "image").when(n == 3, "formula")
        .when(n == 4, "table").when(n == 5, "list").when(n == 6, "quote").otherwise("paragraph")
    )
    word = t.cast("string")
    payload = (
        F.when(n == 1, F.col("text"))
        .when(n == 2, F.when(c % 5 == 0, " ").otherwise(
            F.concat(F.lit(" https://img.example.org/"), word, F.lit(".png "))))
        .when(n == 3, F.when(c % 4 == 0, " \n").otherwise(F.concat(F.lit("x^"), word)))
        .when(n == 4, F.concat(F.lit("<table><tr><td>"), word, F.lit("</td></tr></table>")))
    )
    text = (
        F.when(n == 1, "code").when(n == 2, "image").when(n == 3, "formula").when(n == 4, "table")
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "conversations").select(
        c.alias("doc_id"), t.alias("block_idx"), kind.alias("type"),
        F.when(n == 0, 1 + t % 4).cast("int").alias("level"),
        text.alias("text"), payload.alias("payload"),
        (1 + F.floor(t / 2)).alias("page"),
    )


def para_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def md_docs(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """Markdown documents: each line of a document gets the markup of its position."""
    body = template.replace("{i}", "i")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.expr(f"array_join(transform(split(text, '\\n'), (l, i) -> {body}), '\\n')").alias("text"))


# Markup placed after the first heading of a page, so that every element kind occurs.
RICH_MARKUP = (
    "<blockquote><p>Quoted {t}</p><p>again</p></blockquote>"
    "<pre class=\"x\"><code class=\"hljs language-Py\">a = 1\n  b &lt; 2</code></pre>"
    "<ul><li>one {i}<li>two <ul><li>inner</li></ul></li></ul><ol><li>first</li><li><b>second</b> {t}</li></ol>"
    "<figure><img src=\"/img/{i}.png\" alt=\" Fig {i} \"><figcaption>Caption <i>{i}</i></figcaption></figure>"
    "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td><td>{i}</td></tr></table>"
    "<img src=\"data:image/gif;base64,R0\" data-src=\"../lazy/{i}.jpg\"><img src=\"pix.png\" width=\"1\" height=\"1\">"
    "<img src=\"anim.gif\"><img src=\"//cdn.example.org/p.jpg?x=1\"><img src=\"/img/{i}.png\">"
    "<math alttext=\"x^{i}\"><mi>x</mi></math><div class=\"post\">only <b>inline</b> text</div>"
    "<section>loose <b>bold</b> tail<p>para</p></section>"
)
RICH_HEAD = (
    "<meta property=\"og:title\" content=\"OG {i}\"><meta name=\"author\" content=\"Ann &amp; Bo\">"
    "<meta name=\"description\" content=\"{{tpl}}\"><meta property=\"og:description\" content=\"Desc {i}\">"
    "<script type=\"application/ld+json\">{\"datePublished\": \"2024-01-0{d}\", \"publisher\": {\"name\": \"Pub\"}}</script>"
)


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    title = F.regexp_extract("html", "<h1>(.*?)</h1>", 1)

    def fill(template: str):
        out = F.replace(F.lit(template), F.lit("{i}"), i)
        out = F.replace(out, F.lit("{d}"), (1 + F.col("page_id") % 9).cast("string"))
        return F.replace(out, F.lit("{t}"), title)

    body = F.replace("html", F.lit("</h1>"), F.concat(F.lit("</h1>"), fill(RICH_MARKUP)))
    return table(spark, sf_dir, "pages").select(
        "page_id", "url",
        F.when(F.col("page_id") % 2 == 0, F.replace(body, F.lit("<head>"), F.concat(F.lit("<head>"), fill(RICH_HEAD))))
        .otherwise(body).alias("html"))


# Address variants by page_id % 12; u is the page address.
URL_CASE = """CASE page_id % 12
  WHEN 0 THEN u WHEN 1 THEN '  ' || u || '  ' WHEN 2 THEN regexp_replace(u, '^https?://', '')
  WHEN 3 THEN regexp_replace(u, '^https?', 'ftp') WHEN 4 THEN regexp_replace(u, '^https?', 'FILE')
  WHEN 5 THEN 'http://10.0.0.' || (page_id % 256) || '/x' WHEN 6 THEN 'localhost/' || page_id
  WHEN 7 THEN 'https://nodots' || page_id || '/' WHEN 8 THEN regexp_replace(u, 'example', 'exa..mple')
  WHEN 9 THEN '   ' WHEN 10 THEN 'https:///path' || page_id ELSE u || '/a b' END"""

# A fetch log made from pages.
FETCH_LOG = """SELECT page_id, url AS requested_url,
  CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '/[a-z]+/.*', '/Login?x=1') WHEN 2 THEN url || '/more'
    WHEN 3 THEN regexp_replace(url, '[?#].*', '') || '?next=/home' WHEN 4 THEN url || '/auth/start' ELSE url || '.PDF' END AS landed_url,
  CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 202 WHEN 2 THEN 204 ELSE 200 END AS status,
  CASE page_id % 5 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'Application/XHTML+xml' WHEN 2 THEN 'image/png'
    WHEN 3 THEN 'application/pdf' END AS content_type,
  CASE WHEN page_id % 11 = 0 THEN 40 ELSE length(html) END AS n_bytes,
  CASE WHEN page_id % 13 = 0 THEN '%PDF-1.7' ELSE substr(html, 1, 8) END AS head FROM pages"""


def url_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("u")).selectExpr(
        "page_id", f"{URL_CASE} AS url", "u AS page_url")


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FETCH_LOG.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages"))


def _safe(col: str):
    return F.replace(F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


# E-book markup by line position; {i} is the zero-based index and l the escaped line.
FB2_LINE = """CASE {i} % 5
  WHEN 0 THEN '<section><title><p>' || l || '</p></title>' WHEN 1 THEN '<epigraph><p>' || l || '</p></epigraph>'
  WHEN 3 THEN '<poem><stanza><v>' || l || '</v></stanza></poem>' ELSE '<p>' || l || '</p>' END"""


def fb2_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", _safe("text").alias("t"))
    body = F.expr(f"array_join(transform(split(t, '\\n'), (l, i) -> {FB2_LINE.replace('{i}', 'i')}), '')")
    who = F.col("doc_id").cast("string")
    return docs.select("doc_id", F.concat(
        F.lit("<FictionBook><description><title-info><author><first-name>First</first-name></author><author><first-name>F"),
        who, F.lit("</first-name><last-name>"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")),
        F.lit("</last-name></author><book-title>Book &amp; "), who,
        F.lit("</book-title></title-info></description><body>"), body,
        F.expr("repeat('</section>', cast(ceil(size(split(t, '\\n')) / 5) as int))"),
        F.lit("</body><binary id=\"x\">AAAA</binary></FictionBook>")).alias("xml"))


def package_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """E-book packages: one per conversation, one file per turn, read in reverse turn order."""
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("pkg_id"), F.col("turn"), _safe("text").alias("t"))
    n = F.col("turn").cast("string")
    item, href = F.concat(F.lit("c"), n), F.concat(F.lit("te%20xt/./ch"), n, F.lit(".xhtml"))
    content = F.concat(
        F.lit("<html><head><title>x</title></head><body><h1 id=\"top\">Chapter "), n, F.lit("</h1><p>start here <a id=\"mid\"/>"),
        F.col("t"), F.lit("</p><table id=\"tab\"><tr><td>1</td></tr></table><ul><li>item</li></ul><p id=\"end\">the end</p></body></html>"))
    members = c.select("pkg_id", F.concat(F.lit("OEBPS/te xt/ch"), n, F.lit(".xhtml")).alias("path"), content.alias("content"))
    manifest = c.select("pkg_id", item.alias("item_id"), F.lit("OEBPS").alias("folder"), href.alias("href"))
    spine = c.select("pkg_id", (100 - F.col("turn")).alias("spine_idx"), item.alias("item_id"))
    titles = c.where("turn = 0").select("pkg_id", F.concat(F.lit("Package "), F.col("pkg_id").cast("string")).alias("title"))
    # A chapter at the top level and its marked places below it.
    link = lambda a, text: F.concat(F.lit("<li><a href=\"te%20xt/ch"), n, F.lit(f".xhtml{a}\">{text} "), n, F.lit("</a>"))
    li = F.concat(link("#top", "Part"), F.lit("<ol>"), link("#mid", "Mid"), F.lit("</li>"), link("#none", "Gone"), F.lit("</li></ol></li>"))
    navs = c.groupBy("pkg_id").agg(F.sort_array(F.collect_list(F.struct("turn", li.alias("li")))).alias("x")).select(
        "pkg_id", F.concat(F.lit("<html><body><nav epub:type=\"toc\"><ol>"), F.array_join(F.transform("x", lambda r: r["li"]), ""),
                           F.lit("</ol></nav><nav><ol><li><a href=\"z\">z</a></li></ol></nav></body></html>")).alias("content")
    ).where("pkg_id % 3 = 0")
    point = F.concat(F.lit("<navPoint><navLabel><text>Part "), n, F.lit("</text></navLabel><content src=\"te%20xt/ch"), n,
                     F.lit(".xhtml\"/><navPoint><navLabel><text>End</text></navLabel><content src=\"te%20xt/ch"), n,
                     F.lit(".xhtml#end\"/></navPoint></navPoint>"))
    ncxs = c.groupBy("pkg_id").agg(F.sort_array(F.collect_list(F.struct("turn", point.alias("p")))).alias("x")).select(
        "pkg_id", F.concat(F.lit("<ncx><navMap>"), F.array_join(F.transform("x", lambda r: r["p"]), ""),
                           F.lit("</navMap></ncx>")).alias("content")).where("pkg_id % 3 = 1")
    return {"members": members, "manifest": manifest, "spine": spine, "titles": titles, "navs": navs, "ncxs": ncxs}


def package_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packages as stored members only: pkg_id, path, content. The order of the files, and
    where navigation is found, stand in XML with prefixes, comments and both kinds of quotes."""
    t = package_tables(spark, sf_dir)
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pkg_id"), F.col("turn"))
    n, late = F.col("turn").cast("string"), F.col("pkg_id") % 3 == 1
    items = c.groupBy("pkg_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(
        F.col("turn"),
        F.concat(F.lit("<item media-type='application/xhtml+xml' href=\"te%20xt/./ch"), n, F.lit(".xhtml\" id='c"), n, F.lit("'/>")).alias("item"),
        F.concat(F.lit("<opf:itemref linear=\"a>b\" idref=\"c"), n, F.lit("\"/>")).alias("ref")))), lambda x: x).alias("x"))
    opf = items.select("pkg_id", F.concat(
        F.lit("<?xml version='1.0'?><opf:package xmlns:opf='o'><opf:metadata><dc:title>Package &#38;#x"),
        F.lit(";</dc:title><dc:title id='t'>Package "), F.col("pkg_id").cast("string"),
        F.lit("</dc:title><dc:title/><dc:creator> A &amp; B </dc:creator></opf:metadata><manifest><!-- <item id='c1' href='no'/> -->"
              "<item id='c0' href='replaced.xhtml'/>"),
        F.array_join(F.transform("x", lambda r: r["item"]), ""),
        F.when(F.col("pkg_id") % 3 == 0, "<item id='nav' href='nav.xhtml' properties='scripted nav'/>").otherwise(""),
        F.when(late, "<item id='old' href='no.ncx' media-type='application/x-dtbncx+xml'/><item id='toc' href='./toc.ncx'/>").otherwise(""),
        F.lit("</manifest><spine"), F.when(late, " toc='toc'").otherwise(""), F.lit("><itemref linear='no'/><itemref idref='gone'/>"),
        F.array_join(F.transform(F.reverse("x"), lambda r: r["ref"]), ""), F.lit("</spine></opf:package>")).alias("content"))
    container = items.select("pkg_id", F.lit("META-INF/container.xml").alias("path"), F.lit(
        "<container><rootfiles><rootfile full-path='x.opf'/><n:rootfile full-path=\"OEBPS/content.opf\"/></rootfiles></container>").alias("content"))
    at = lambda df, path: df.select("pkg_id", F.lit(path).alias("path"), "content")
    return (t["members"].select("pkg_id", "path", "content").unionByName(container).unionByName(at(opf, "OEBPS/content.opf"))
            .unionByName(at(t["navs"], "OEBPS/nav.xhtml")).unionByName(at(t["ncxs"], "OEBPS/toc.ncx")))


# One paragraph of a document body by line position; l is the escaped line, i its zero-based index.
BODY_PARAGRAPH = """concat('<w:p><w:pPr><w:pStyle w:val="', CASE i % 9 WHEN 0 THEN 'Heading2' WHEN 1 THEN 'S1'
  WHEN 2 THEN 'IntenseQuote' WHEN 3 THEN 'ListBullet' WHEN 4 THEN 'Subtitle' WHEN 5 THEN 'S2' ELSE 'Normal' END, '"/>',
  CASE WHEN i % 13 = 8 THEN concat('<w:numPr><w:ilvl w:val="', i % 3, '"/></w:numPr>') ELSE '' END,
  '<w:rPr><w:rFonts w:ascii="Arial"/></w:rPr></w:pPr><w:r><w:rPr><w:rFonts w:ascii="',
  CASE WHEN i % 9 IN (6, 7) THEN 'Courier New" w:cs="Consolas' ELSE 'Arial' END, '"/></w:rPr><w:t>', l,
  '</w:t></w:r><w:r><w:t xml:space="preserve">  </w:t></w:r><m:oMathPara/>',
  CASE WHEN i % 3 = 0 THEN concat('<w:r><w:footnoteReference w:id="', i, '"/></w:r>') ELSE '' END,
  CASE WHEN i % 5 = 0 THEN concat('<w:r><w:drawing><a:blip r:embed="rId', i, '"/></w:drawing></w:r>') ELSE '' END, '</w:p>')"""


def office_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-processor packages as stored members: doc_id, path, content. One paragraph per document
    line, then a table for every four lines, with a cell per word."""
    safe = F.replace(F.replace(_safe("text"), F.lit("'"), F.lit("&#39;")), F.lit("ü"), F.lit("&#xFC;"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(safe, "\n").alias("s"))
    each = lambda sql: F.array_join(F.expr(f"transform(s, (l, i) -> {sql})"), "")
    row = ("concat('<w:tr>', array_join(transform(split(l, ' '), c -> concat('<w:tc><w:p><w:r><w:t>', c, '</w:t></w:r></w:p></w:tc>')), ''), '</w:tr>')")
    grids = (f"concat(CASE WHEN i % 4 = 0 THEN '<w:tbl><w:tblPr/>' ELSE '' END, {row}, "
             "CASE WHEN i % 4 = 3 OR i = size(s) - 1 THEN '</w:tbl>' ELSE '' END)")
    body = F.concat(F.lit("<w:document><w:body>"), each(BODY_PARAGRAPH), each(grids), F.lit("<w:sectPr/></w:body></w:document>"))
    notes = F.concat(F.lit("<w:footnotes>"), each(
        "CASE WHEN i % 4 < 2 THEN concat('<w:footnote w:id=\"', i, '\"><w:p><w:r><w:t>', l, '</w:t></w:r></w:p></w:footnote>') ELSE '' END"),
        F.lit("</w:footnotes>"))
    rels = F.concat(F.lit("<Relationships>"), each(
        "concat('<Relationship Id=\"rId', i, '\" Target=\"./media/image', i, '.png\"/>')"), F.lit("</Relationships>"))
    styles = F.lit("<w:styles><w:style w:styleId='S1'><w:name w:val='Заголовок 3'/></w:style>"
                   "<w:style w:styleId=\"S2\"><w:name w:val=\"Block Text\"/></w:style></w:styles>")
    # A table of its own for each member, so that a reader of one path makes no other.
    at = lambda path, content: docs.select("doc_id", F.lit(path).alias("path"), content.alias("content"))
    media = docs.select("doc_id", F.explode(F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: i % 2 == 0)).alias("i")).select(
        "doc_id", F.concat(F.lit("word/media/image"), F.col("i").cast("string"), F.lit(".png")).alias("path"),
        F.lit(None).cast("string").alias("content"))
    return (at("word/document.xml", body).unionByName(at("word/footnotes.xml", notes))
            .unionByName(at("word/_rels/document.xml.rels", rels)).unionByName(at("word/styles.xml", styles)).unionByName(media))


def office_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Word-processor rows: one paragraph per document line."""
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("para_idx", "line"))
    i = F.col("para_idx")
    style = (
        F.when(i % 9 == 0, "Heading2").when(i % 9 == 1, "S1").when(i % 9 == 2, "IntenseQuote").when(i % 9 == 3, "ListBullet")
        .when(i % 9 == 4, "Subtitle").when(i % 9 == 5, "S2").otherwise("Normal"))
    paras = lines.select("doc_id", "para_idx", style.alias("style_id"), F.when(i % 13 == 8, i % 3).cast("int").alias("num_level"))
    styles = lines.select("doc_id").distinct().select("doc_id", F.inline(F.array(
        F.struct(F.lit("S1").alias("style_id"), F.lit("Заголовок 3").alias("style_name")),
        F.struct(F.lit("S2").alias("style_id"), F.lit("Block Text").alias("style_name")))))
    mono = F.when((i % 9).isin(6, 7), F.array(F.lit("Courier New"), F.lit("Consolas"))).otherwise(F.array(F.lit("Arial")))
    half = F.floor(F.length("line") / 2).cast("int")
    runs = lines.select("doc_id", "para_idx", F.posexplode(F.array(
        F.substring("line", F.lit(1), half), F.substring(F.col("line"), half + 1, F.length("line")), F.lit("  "))).alias("run_idx", "text"),
        mono.alias("fonts"))
    notes = lines.where(i % 4 < 2).select("doc_id", i.cast("string").alias("note_id"), F.col("line").alias("text"))
    refs = lines.where(i % 3 == 0).select("doc_id", i.cast("string").alias("note_id"))
    uses = lines.where(i % 5 == 0).select("doc_id", "para_idx", F.concat(F.lit("rId"), i.cast("string")).alias("rel_id"))
    rels = lines.select("doc_id", F.concat(F.lit("rId"), i.cast("string")).alias("rel_id"),
                        F.concat(F.lit("./media/image"), i.cast("string"), F.lit(".png")).alias("target"))
    media = lines.where(i % 2 == 0).select("doc_id", F.concat(F.lit("media/image"), i.cast("string"), F.lit(".png")).alias("path"))
    # Cells are many times the rows of their text: the text is placed by document, and no cell moves again.
    placed = by_key(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("para_idx", "line"))
    cells = placed.select("doc_id", F.floor(i / 4).alias("table_idx"), (i % 4).alias("row_idx"),
                         F.posexplode(F.split("line", " ")).alias("cell_idx", "text"))
    return {"paras": paras, "styles": styles, "runs": runs, "notes": notes, "refs": refs, "uses": uses,
            "rels": rels, "media": media, "cells": cells}


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned lines: twenty document lines a page, two columns on even documents, and a
    running header, a page number and a footnote line on every page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("s"))
    i = F.col("i")
    two = F.col("doc_id") % 2 == 0
    j = i % 20
    jj = F.when(two, j % 10).otherwise(j)
    left = F.when(two & (j >= 10), 320.0).otherwise(60.0)
    y = 760.0 - jj * 18 - F.floor(jj / 5) * 14
    body = docs.select("doc_id", F.posexplode("s").alias("i", "text")).select(
        "doc_id", (1 + F.floor(i / 20)).cast("int").alias("page"), j.cast("int").alias("line_idx"), "text",
        left.alias("x_min"), F.when(two & (j < 10), 280.0).otherwise(540.0).alias("x_max"), y.alias("y_center"),
        F.when(i % 15 == 0, 18.0).otherwise(11.0).alias("font_size"), (i % 9 == 0).alias("bold"))
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(1), (1 + F.floor((F.size("s") - 1) / 20)).cast("int"))).alias("page"))
    extra = pages.select("doc_id", "page", F.inline(F.array(
        F.struct(F.lit(-1).alias("line_idx"), F.concat(F.lit("Running Header "), F.col("doc_id").cast("string")).alias("text"),
                 F.lit(60.0).alias("x_min"), F.lit(300.0).alias("x_max"), F.lit(830.0).alias("y_center")),
        F.struct(F.lit(100).alias("line_idx"), F.concat(F.lit("1) see note "), F.col("page").cast("string")).alias("text"),
                 F.lit(60.0).alias("x_min"), F.lit(300.0).alias("x_max"), F.lit(60.0).alias("y_center")),
        F.struct(F.lit(101).alias("line_idx"), F.concat(F.lit("- "), F.col("page").cast("string"), F.lit(" -")).alias("text"),
                 F.lit(290.0).alias("x_min"), F.lit(310.0).alias("x_max"), F.lit(20.0).alias("y_center")))),
    ).withColumns({"font_size": F.lit(11.0), "bold": F.lit(False)})
    return body.unionByName(extra).withColumns({
        "y_min": F.col("y_center") - 6, "y_max": F.col("y_center") + 6,
        "page_width": F.lit(595.0), "page_height": F.lit(842.0)})


def layout_chars(lines: DataFrame) -> DataFrame:
    """Characters of layout lines, six points wide; each 17th is a stray glyph far to the left, and
    every tenth is followed by a cell-wide gap."""
    return lines.select(
        "doc_id", "page", "line_idx", "x_min", "y_min", "y_max", "page_width",
        F.posexplode(F.split("text", "")).alias("char_idx", "ch"),
    ).where("ch <> ''").select(
        "doc_id", "page", "line_idx", "char_idx", "page_width", "y_min", "y_max",
        F.when(F.col("char_idx") % 40 == 39, -300.0).otherwise(
            F.col("x_min") + F.col("char_idx") * 6 + F.floor(F.col("char_idx") / 10) * 30).alias("x_min"), "ch",
    ).withColumn("x_max", F.col("x_min") + 5)


def layout_glyphs(lines: DataFrame, *more: str) -> DataFrame:
    """The same characters as arrays on the row of their line; lines without characters have no row."""
    n = F.length("text")
    at = lambda i: F.when(i % 40 == 39, -300.0).otherwise(F.col("_left") + i * 6 + F.floor(i / 10) * 30)
    return lines.where(n > 0).withColumnRenamed("x_min", "_left").select(
        "doc_id", "page", *more, "line_idx", "page_width", F.transform(F.sequence(F.lit(0), n - 1), at).alias("x_min"),
        F.array_repeat("y_min", n).alias("y_min"), F.array_repeat("y_max", n).alias("y_max"),
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i) + 5).alias("x_max"))


def wide_ordinal(outer: str, inner: str):
    """One number that orders by outer, then inner; inner may use all 32 bits."""
    return F.shiftleft(F.col(outer).cast("long"), 32) + F.col(inner)


def page_words(lines: DataFrame) -> DataFrame:
    """Word boxes of layout lines, forty points apart."""
    return lines.select(
        "doc_id", "page", "line_idx", "x_min", "y_min",
        F.posexplode(F.split("text", " ")).alias("k", "word")).where("word <> ''").select(
        "doc_id", "page", wide_ordinal("line_idx", "k").alias("word_idx"), "word",
        (F.col("x_min") + F.col("k") * 40).alias("x"), F.col("y_min").alias("y"), F.lit(35.0).alias("w"), F.lit(12.0).alias("h"))


def ocr_observations(lines: DataFrame) -> DataFrame:
    """Recognised lines of the pages in boxes from 0 to 1 with the origin at the bottom left."""
    return lines.select(
        "doc_id", "page", F.col("line_idx").alias("obs_idx"), "text",
        (0.3 + (F.col("line_idx") + 1) % 8 * 0.1).alias("confidence"),
        (F.col("x_min") / 595).alias("x"), (F.col("y_min") / 842).alias("y"),
        ((F.col("x_max") - F.col("x_min")) / 595).alias("w"), F.lit(12.0 / 842).alias("h"), "page_width", "page_height")
