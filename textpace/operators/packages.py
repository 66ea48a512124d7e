"""E-book documents and packages: blocks, reading order, offsets and outline links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textpace.functions import web as H
from textpace.functions import words as W
from textpace.functions import xml as X
from textpace.operators import markup as K
from textpace.operators.ordered import running, span_bucket

# --- fixed values: the container member and the older navigation type ---
CONTAINER = "META-INF/container.xml"
NCX_TYPE = "application/x-dtbncx+xml"
# --- end of fixed values ---
SPLITS = [*K.HEADINGS, "p", "div", "blockquote", "pre", "li"]


def _depth(tag: Column, name: str, w) -> Column:
    return F.sum(K._sign(F.coalesce(tag == name, F.lit(False)))).over(w)


def ebook_blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks of e-book XML: section titles as headings at section depth (1 to 6), epigraph
    paragraphs as quotes, verse lines and paragraphs; text outside the body is left out."""
    tag, closes = F.col("tag"), F.col("is_close")
    toks = K.tokens(docs, key, "xml")
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    state = toks.select(
        "*", _depth(tag, "body", upto).alias("body"), _depth(tag, "section", upto).alias("depth"),
        _depth(tag, "title", upto).alias("title"), _depth(tag, "epigraph", upto).alias("epi"),
        _depth(tag, "binary", upto).alias("bin"),
    )
    in_title = (F.col("title") > 0) & ~((tag == "title") & closes)
    edge = F.col("body") > 0
    edge = edge & (
        (tag == "title") | ((tag == "epigraph") & closes)
        | ((tag == "v") & ~closes) | (tag.isin("p", "v") & ~in_title)
    )
    cut = state.select(
        "*", F.sum(F.coalesce(edge, F.lit(False)).cast("int")).over(upto).alias("seg"),
        F.last(F.when(edge, F.struct("tag", "is_close", "depth", "epi")), ignorenulls=True).over(upto).alias("e"),
    ).where((F.col("body") > 0) & (F.col("bin") == 0) & tag.isNull())
    opened = ~F.coalesce(F.col("e.is_close"), F.lit(True))
    kind = (
        F.when(opened & (F.col("e.tag") == "title"), "heading")
        .when(opened & (F.col("e.tag") == "p") & (F.col("e.epi") > 0), "quote").otherwise("paragraph")
    )
    level = F.when(kind == "heading", F.greatest(F.lit(1), F.least(F.lit(6), F.col("e.depth"))))
    parts = cut.groupBy(key, "seg", kind.alias("type"), level.cast("int").alias("level")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "tok"))).alias("p"))
    text = W.trim_space(H.decode_entities(F.array_join(F.transform("p", lambda x: x["tok"]), "")))
    order = Window.partitionBy(key).orderBy("seg")
    return parts.select(key, "seg", "type", "level", text.alias("text")).where("text <> ''").select(
        key, (F.row_number().over(order) - 1).alias("block_idx"), "type", "level", "text")


def ebook_metadata(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Title, and the last author that has a first or last name."""
    info = F.regexp_extract("xml", r"(?is)<title-info>(.*?)</title-info>", 1)
    part = lambda a, n: H.decode_entities(F.regexp_extract(a, rf"(?is)<{n}>(.*?)</{n}>", 1))
    names = F.filter(
        F.transform(
            F.regexp_extract_all(info, F.lit(r"(?is)<author>(.*?)</author>"), F.lit(1)),
            lambda a: F.array_join(F.filter(F.array(part(a, "first-name"), part(a, "last-name")), lambda n: n != ""), " ")),
        lambda n: n != "")
    return docs.select(
        key, F.nullif(part(info, "book-title"), F.lit("")).alias("title"),
        F.try_element_at(names, F.lit(-1)).alias("author"))


def decode_percent(path: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def member_path(folder: Column, href: Column) -> Column:
    """Package path of a link: percent-decoded, relative to a folder, dot segments removed."""
    joined = F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), decode_percent(href))
    return F.array_join(
        F.aggregate(
            F.split(joined, "/"), F.array().cast("array<string>"),
            lambda s, p: F.when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))
            .when(p.isin(".", ""), s).otherwise(F.concat(s, F.array(p)))), "/")


def package_documents(members: DataFrame) -> DataFrame:
    """The package document of each package: pkg_id, folder, xml. The last root file named counts;
    packages without one, or whose root file is not stored, give no row."""
    roots = F.transform(
        X.opening_tags(F.col("content"), "rootfile"), lambda t: X.attribute(t, "full-path"))
    named = members.where(F.col("path") == CONTAINER).groupBy("pkg_id").agg(F.max("content").alias("content")).select(
        "pkg_id", F.try_element_at(F.filter(roots, lambda r: r.isNotNull()), F.lit(-1)).alias("path"))
    return members.join(named.where("path IS NOT NULL"), ["pkg_id", "path"], "left_semi").groupBy("pkg_id", "path").agg(
        F.max("content").alias("content")).select(
        "pkg_id", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), X.without_comments(F.col("content")).alias("xml"))


def manifest_items(documents: DataFrame) -> DataFrame:
    """Items of package documents: pkg_id, item_idx, item_id, folder, href, media_type, properties.
    Of items with one id the last counts."""
    a = lambda n: X.attribute(F.col("t"), n)
    items = documents.select("pkg_id", "folder", F.posexplode(X.opening_tags(F.col("xml"), "item")).alias("item_idx", "t")).select(
        "pkg_id", "item_idx", a("id").alias("item_id"), "folder", a("href").alias("href"), a("media-type").alias("media_type"),
        F.filter(F.split(F.coalesce(a("properties"), F.lit("")), " "), lambda p: p != "").alias("properties"))
    last = Window.partitionBy("pkg_id", "item_id").orderBy(F.desc("item_idx"))
    return items.where("item_id IS NOT NULL AND href IS NOT NULL").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def spine_items(documents: DataFrame) -> DataFrame:
    """Reading order of package documents: pkg_id, spine_idx, item_id."""
    refs = F.filter(F.transform(X.opening_tags(F.col("xml"), "itemref"), lambda t: X.attribute(t, "idref")), lambda r: r.isNotNull())
    return documents.select("pkg_id", F.posexplode(refs).alias("spine_idx", "item_id"))


def package_titles(documents: DataFrame) -> DataFrame:
    """pkg_id, title and author: the last element of each that has text, else null."""
    meta = F.regexp_extract("xml", r"(?s)<(?:[\w.-]+:)?metadata\b[^>]*>(.*?)</(?:[\w.-]+:)?metadata\s*>", 1)

    def last(name: str) -> Column:
        texts = F.transform(
            F.regexp_extract_all(meta, F.lit(rf"(?s)<(?:[\w.-]+:)?{name}\b[^>]*(?<!/)>([^<]*)</"), F.lit(1)),
            lambda t: W.trim_space(X.decode(t)))
        return F.try_element_at(F.filter(texts, lambda t: t != ""), F.lit(-1))

    return documents.select("pkg_id", last("title").alias("title"), last("creator").alias("author"))


def navigation_members(documents: DataFrame, manifest: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """Stored navigation files: ``navs`` (the last item with the property nav) and ``ncxs`` (the item
    that the spine's toc names, else the first of the older type); pkg_id, folder, content.

    Links inside are relative to the file's own folder, which ``folder`` gives.
    """
    toc = documents.select("pkg_id", X.attribute(F.get(X.opening_tags(F.col("xml"), "spine"), F.lit(0)), "toc").alias("toc"))
    path = member_path(F.col("folder"), F.col("href"))
    items = manifest.join(toc, "pkg_id", "left").select("pkg_id", "item_idx", path.alias("path"), "media_type", "properties",
                                                       (F.col("item_id") == F.col("toc")).alias("named"))
    older = F.col("media_type") == NCX_TYPE
    picked = items.groupBy("pkg_id").agg(
        F.max_by("path", F.when(F.array_contains("properties", "nav"), F.col("item_idx"))).alias("navs"),
        F.max_by("path", F.when(F.col("named"), F.col("item_idx"))).alias("_named"),
        F.min_by("path", F.when(older, F.col("item_idx"))).alias("_older"),
    ).select("pkg_id", "navs", F.coalesce("_named", "_older").alias("ncxs"))
    stored = members.groupBy("pkg_id", "path").agg(F.max("content").alias("content"))

    def files(kind: str) -> DataFrame:
        return picked.select("pkg_id", F.col(kind).alias("path")).where("path IS NOT NULL").join(stored, ["pkg_id", "path"]).select(
            "pkg_id", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), "content")

    return {"navs": files("navs"), "ncxs": files("ncxs")}


def reading_order(spine: DataFrame, manifest: DataFrame, members: DataFrame) -> DataFrame:
    """Files in spine order: pkg_id, spine_idx, path, content. Unknown items vanish."""
    hrefs = spine.join(manifest, ["pkg_id", "item_id"]).select(
        "pkg_id", "spine_idx", member_path(F.col("folder"), F.col("href")).alias("path"))
    return hrefs.join(members, ["pkg_id", "path"]).select("pkg_id", "spine_idx", "path", "content")


def _segments(files: DataFrame, keys: list[str]) -> DataFrame:
    """Body tokens of XHTML files with their segment, its type, and one placeholder per unit."""
    tag, closes = F.col("tag"), F.col("is_close")
    packed = files.select(F.struct(*keys).alias("_k"), "content")
    body = F.regexp_replace(F.regexp_extract("content", r"(?is)<body[^>]*>(.*)</body>", 1),
                            r"(?is)<(script|style|svg)\b[^>]*>.*?</\1>", "")
    toks = K.tokens(packed.select("_k", body.alias("html")), "_k")
    upto = Window.partitionBy("_k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    unit = F.coalesce(tag.isin("table", "math"), F.lit(False))
    deep = toks.select("*", F.sum(K._sign(unit)).over(upto).alias("ud"))
    opens = unit & ~closes & (F.col("ud") == 1)
    shuts = unit & closes & (F.col("ud") == 0)
    is_img = F.coalesce(tag == "img", F.lit(False)) & (F.col("ud") == 0)
    edge = (F.coalesce(tag.isin(SPLITS), F.lit(False)) & (F.col("ud") == 0)) | opens | shuts | is_img
    # An image is a segment of its own, so the text after it starts another.
    return deep.select(
        "*", (F.sum(edge.cast("int")).over(upto) + F.sum(is_img.cast("int")).over(upto)
              - F.when(is_img, 1).otherwise(0)).alias("seg"),
        F.last(F.when(edge, F.struct("tag", "is_close")), ignorenulls=True).over(upto).alias("e"),
        is_img.alias("is_img"),
    )


def xhtml_blocks(files: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of XHTML files: keys, block_idx, type, level, text, payload, n_words."""
    toks = _segments(files, keys)
    open_tag = F.when(~F.col("e.is_close"), F.col("e.tag"))
    kind = (
        F.when(F.col("is_img"), "image")
        .when(open_tag.isin(K.HEADINGS), "heading").when(open_tag == "blockquote", "quote")
        .when(open_tag == "pre", "code").when(open_tag == "li", "list").when(open_tag == "table", "table")
        .when(open_tag == "math", "formula").otherwise("paragraph")
    )
    text = F.when(F.col("tag").isNull(), F.struct("pos", F.col("tok").alias("t"))).when(
        F.col("tag") == "br", F.struct("pos", F.lit(" ").alias("t")))
    raw = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["t"]), "")
    whole = F.when(F.col("ud") > 0, F.struct("pos", F.col("tok").alias("t")))
    agg = toks.select("*", kind.alias("type"), F.when(kind == "heading", F.substring("e.tag", 2, 1).cast("int")).alias("level")) \
        .groupBy("_k", "seg", "type", "level").agg(
            H.decode_entities(raw(text)).alias("raw"), raw(whole).alias("outer"),
            F.min_by("tok", "pos").alias("first_tok"))
    plain = H.collapse(F.col("raw"))
    payload = (
        F.when(F.col("type") == "image", F.nullif(H.attr(F.col("first_tok"), "src"), F.lit("")))
        .when(F.col("type") == "code", F.nullif(W.trim_space(F.col("raw")), F.lit("")))
        .when(F.col("type") == "table", F.when(plain != "", F.col("outer")))
        .when(F.col("type") == "formula", K.latex_of(F.col("outer")))
    )
    placed = F.col("type").isin("image", "code", "table", "formula")
    built = agg.select("_k", "seg", "type", "level", payload.alias("payload"),
                       F.when(placed, F.col("type")).otherwise(plain).alias("text"))
    kept = built.where(F.when(placed, F.col("payload").isNotNull()).otherwise(F.col("text") != ""))
    order = Window.partitionBy("_k").orderBy("seg")
    return kept.select(
        *[F.col(f"_k.{k}").alias(k) for k in keys], (F.row_number().over(order) - 1).alias("block_idx"),
        "seg", "type", "level", "text", "payload", W.word_count(F.col("text")).alias("n_words"))


def _words_before(toks: DataFrame, anchor: Column) -> DataFrame:
    """Words of a segment before each of its anchors: _k, seg, anchor, pos, inside.

    No word goes over white space, so a text piece with white space ends the stretch of pieces
    before it. Stretches are counted once each and summed along the segment; an anchor counts
    again only the open stretch it stands in, which is part of one word or little more.
    """
    shown = F.col("tag").isNull() & (F.col("ud") == 0)
    ends = shown & F.col("tok").rlike(r"[\s\p{Z}]")
    head = F.regexp_extract("tok", r"(?s)^(.*[\s\p{Z}])", 1)
    piece = F.when(ends, F.substring("tok", F.length(head) + 1, F.length("tok"))).otherwise(F.col("tok"))
    along = Window.partitionBy("_k", "seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    stretches = toks.withColumn("_n", F.sum(ends.cast("int")).over(along)).groupBy("_k", "seg", "_n").agg(
        F.max(F.when(ends, head)).alias("head"),
        F.sort_array(F.collect_list(F.when(shown, F.struct("pos", piece.alias("tok"))))).alias("texts"),
        F.collect_list(F.when(anchor.isNotNull(), F.struct("pos", anchor.alias("anchor")))).alias("anchors"))
    joined = lambda texts: F.array_join(F.transform(texts, lambda t: t["tok"]), "")
    order = Window.partitionBy("_k", "seg").orderBy("_n")
    whole = F.concat(F.coalesce(F.lag(joined(F.col("texts"))).over(order), F.lit("")), F.coalesce("head", F.lit("")))
    counted = stretches.withColumn("_w", W.word_count(H.decode_entities(whole))).select(
        "*", F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_done"))
    cut = F.filter("texts", lambda t: t["pos"] < F.col("a.pos"))
    return counted.select("_k", "seg", "_done", "texts", F.explode("anchors").alias("a")).select(
        "_k", "seg", "a.anchor", "a.pos",
        (F.col("_done") + W.word_count(H.decode_entities(joined(cut)))).cast("int").alias("inside"))


def anchor_offsets(files: DataFrame, keys: list[str]) -> DataFrame:
    """First position of every id in a file, in words: finished blocks plus the open one so far."""
    toks = _segments(files, keys)
    anchor = F.nullif(F.when(F.col("tag").isNotNull() & ~F.col("is_close"), H.attr(F.col("tok"), "id")), F.lit(""))
    ids = _words_before(toks, anchor)
    first = ids.groupBy("_k", "anchor").agg(F.min_by(F.struct("seg", "inside"), "pos").alias("f"))
    words = xhtml_blocks(files, keys).select(F.struct(*keys).alias("_k"), "seg", "n_words")
    marks = words.select("_k", "seg", F.lit(1).alias("o"), "n_words", F.lit(None).cast("string").alias("anchor")).unionByName(
        first.select("_k", F.col("f.seg").alias("seg"), F.lit(0).alias("o"), F.lit(0).alias("n_words"), "anchor"))
    before = Window.partitionBy("_k").orderBy("seg", "o").rowsBetween(Window.unboundedPreceding, 0)
    at = marks.select("*", F.sum("n_words").over(before).alias("done")).where("o = 0")
    return at.join(first, ["_k", "anchor"]).select(
        *[F.col(f"_k.{k}").alias(k) for k in keys], "anchor",
        (F.col("done") + F.col("f.inside")).cast("long").alias("offset"))


def file_offsets(files: DataFrame, titles: DataFrame) -> DataFrame:
    """First word of every file in the package stream; the title block comes first."""
    counts = xhtml_blocks(files, ["pkg_id", "spine_idx"]).groupBy("pkg_id", "spine_idx").agg(
        F.sum("n_words").alias("n"))
    all_files = files.select("pkg_id", "spine_idx", "path").join(counts, ["pkg_id", "spine_idx"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))
    summed = running(all_files, ["pkg_id"], ["spine_idx"], span_bucket("spine_idx"), sums={"before": F.col("n")})
    lead = titles.select("pkg_id", W.word_count(F.col("title")).alias("t"))
    return summed.join(lead, "pkg_id", "left").select(
        "pkg_id", "spine_idx", "path", (F.col("before") + F.coalesce("t", F.lit(0))).alias("start_word"),
        F.col("n").alias("n_words"))


def nav_entries(navs: DataFrame, key: str = "pkg_id") -> DataFrame:
    """Links of a navigation page's table of contents; list depth gives the level."""
    tag, closes = F.col("tag"), F.col("is_close")
    toks = K.tokens(navs, key, "content")
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marker = F.lower(F.concat_ws(" ", *[H.attr(F.col("tok"), a) for a in ("epub:type", "type", "role")]))
    nav = F.when(tag == "nav", F.when(closes, 0).when(F.contains(marker, F.lit("toc")), 1).otherwise(0))
    state = toks.select(
        "*", F.coalesce(F.last(nav, ignorenulls=True).over(upto), F.lit(0)).alias("toc"))
    inside = F.col("toc") == 1
    deep = state.where(inside).select(
        "*", F.sum(K._sign(F.coalesce(tag == "ol", F.lit(False)))).over(upto).alias("level"),
        F.sum(F.when((tag == "a") & ~closes, 1).otherwise(0)).over(upto).alias("link"),
        F.last(F.when(tag == "a", ~closes), ignorenulls=True).over(upto).alias("in_a"),
    )
    return _links(deep.where((F.col("level") > 0) & F.col("in_a")), key, "href")


def ncx_entries(ncxs: DataFrame, key: str = "pkg_id") -> DataFrame:
    """Points of an older navigation file; point nesting gives the level."""
    tag, closes = F.col("tag"), F.col("is_close")
    toks = K.tokens(ncxs, key, "content").withColumn("tag", F.regexp_replace("tag", "^.*:", ""))
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    state = toks.select(
        "*", _depth(tag, "navmap", upto).alias("map"), _depth(tag, "navpoint", upto).alias("level"),
        F.sum(F.when((tag == "navpoint") & ~closes, 1).otherwise(0)).over(upto).alias("link"),
        _depth(tag, "text", upto).alias("t"))
    inside = state.where((F.col("map") > 0) & (F.col("level") > 0))
    use = inside.where((F.col("t") > 0) | (tag == "content"))
    return _links(use, key, "src")


def _links(rows: DataFrame, key: str, attribute: str) -> DataFrame:
    got = rows.groupBy(key, "link").agg(
        F.min("level").alias("level"),
        F.min_by(F.nullif(H.attr(F.col("tok"), attribute), F.lit("")),
                 F.when(H.attr(F.col("tok"), attribute) != "", F.col("pos"))).alias("href"),
        F.sort_array(F.collect_list(F.when(F.col("tag").isNull(), F.struct("pos", "tok")))).alias("p"))
    title = W.trim_space(H.decode_entities(F.array_join(F.transform("p", lambda x: x["tok"]), "")))
    return got.select(key, F.col("link").alias("entry_idx"), "level", title.alias("title"), "href").where(
        (F.col("title") != "") & F.col("href").isNotNull())


def resolve_links(entries: DataFrame, offsets: DataFrame, anchors: DataFrame, headings: DataFrame) -> DataFrame:
    """Outline word positions of package links, from the best source that resolves.

    ``entries`` carries pkg_id, source (0 navigation page, 1 older file), folder, entry_idx, level,
    title, href; ``headings`` is the fallback outline. Links join files on path, then anchors.
    """
    path = F.regexp_extract("href", r"^([^#]*)", 1)
    wanted = entries.where(path != "").select(
        "pkg_id", "source", "entry_idx", "level", "title", member_path(F.col("folder"), path).alias("path"),
        F.regexp_extract("href", r"#(.*)$", 1).alias("anchor"))
    starts = offsets.groupBy("pkg_id", "path").agg(F.max_by("start_word", "spine_idx").alias("start_word"),
                                                   F.max("spine_idx").alias("spine_idx"))
    hit = wanted.join(starts, ["pkg_id", "path"]).join(anchors, ["pkg_id", "spine_idx", "anchor"], "left").select(
        "pkg_id", "source", "entry_idx", F.greatest(F.lit(1), F.col("level")).cast("int").alias("level"), "title",
        (F.col("start_word") + F.coalesce("offset", F.lit(0))).alias("word_idx"))
    rest = headings.select(
        "pkg_id", F.lit(2).alias("source"), F.col("toc_idx").alias("entry_idx"), "level", "title", "word_idx")
    both = hit.unionByName(rest)
    best = both.groupBy("pkg_id").agg(F.min("source").alias("source"))
    return both.join(best, ["pkg_id", "source"])
