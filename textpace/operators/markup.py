"""Markup tokens and the blocks, images, formulas and tables found in them.

A page is one row, so every window here is bounded by one page; pages are placed by key before
they are cut into tokens and all windows reuse that placement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textpace.functions import web as H
from textpace.functions.words import trim_space
from textpace.operators.ordered import by_key

HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
# Elements read as one unit, whatever they contain.
WRAPPERS = ["blockquote", "pre", "ul", "ol", "figure", "table", "math", "mjx-container"]
CONTAINERS = ["div", "section", "article", "main", "body", "html", "header", "footer", "nav", "aside",
              "form", "center", "details", "summary", "address", "dl", "dt", "dd", "fieldset", "hr"]
VOID = ["br", "img", "hr", "input", "meta", "link", "wbr", "source", "col", "area", "base", "embed"]


def tokens(pages: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    """Markup tokens: key, pos, tok, tag (null for text), is_close. Comments are dropped."""
    rows = by_key(pages.select(key, text), key).select(
        key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(H.MARKUP), F.lit(0))).alias("pos", "tok"))
    tag = F.lower(F.regexp_extract("tok", r"^</?([A-Za-z][A-Za-z0-9:\-]*)", 1))
    return rows.where(~F.col("tok").startswith("<!")).select(
        key, "pos", "tok", F.when(F.col("tok").startswith("<"), tag).alias("tag"),
        F.col("tok").startswith("</").alias("is_close"),
    )


def body_html(html: Column) -> Column:
    """Page markup without head, scripts, comments and boilerplate elements."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?is)<head[^>]*>.*?</head>", "")
    return H.drop_boilerplate(bare)


def _sign(tag_test: Column) -> Column:
    return F.when(tag_test, F.when(F.col("is_close"), -1).otherwise(1)).otherwise(0)


def blocks(pages: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    """Typed blocks of page markup: key, block_idx, type, level, text and payload columns.

    Depths and block boundaries are running sums over markup tokens. Quotes, code, lists, figures,
    tables and formulas are read as units; other text belongs to the last opened block. A container
    with block children gives one paragraph per text node or inline element, one without gives a
    single paragraph.
    """
    tag, closes = F.col("tag"), F.col("is_close")
    w = Window.partitionBy(key).orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    toks = tokens(pages, key, text)
    is_wrap = F.coalesce(tag.isin(WRAPPERS), F.lit(False))
    selfclose = F.col("tok").endswith("/>")
    depth = toks.select(
        "*", F.sum(F.when(selfclose, 0).otherwise(_sign(is_wrap))).over(upto).alias("wd"),
        F.sum(F.when(selfclose, 0).otherwise(_sign(F.coalesce(tag.isin("ul", "ol"), F.lit(False))))).over(upto).alias("ld"),
    )
    opens_unit = is_wrap & ~closes & (F.col("wd") == 1)
    in_unit = (F.col("wd") > 0) | (is_wrap & closes & (F.col("wd") == 0))
    boundary = tag.isin([*HEADINGS, "p", *CONTAINERS]) & ~in_unit
    staged = depth.select(
        "*", in_unit.alias("in_unit"),
        F.sum(opens_unit.cast("int")).over(upto).alias("unit"),
        F.last(F.when(opens_unit, tag), ignorenulls=True).over(upto).alias("unit_tag"),
        F.coalesce(boundary, F.lit(False)).alias("boundary"),
    )
    li_opens = (tag == "li") & ~closes & (F.col("ld") == 1) & F.col("in_unit")
    # A unit splits the text around it, so its start and end both begin a new segment.
    cuts = F.col("boundary") | opens_unit | (is_wrap & closes & (F.col("wd") == 0))
    seg = staged.select(
        "*", cuts.alias("cuts"), F.sum(cuts.cast("int")).over(upto).alias("seg"),
        F.coalesce(F.sum(F.coalesce(li_opens, F.lit(False)).cast("int")).over(upto), F.lit(0)).alias("item"),
        F.last(F.when(F.col("boundary"), F.struct("tag", "is_close")), ignorenulls=True).over(upto).alias("b"),
    )
    seg = seg.withColumn(
        "item", F.col("item") - F.last(F.when(opens_unit, F.col("item")), ignorenulls=True).over(upto))
    s = Window.partitionBy(key, "seg").orderBy("pos")
    seg_upto = s.rowsBetween(Window.unboundedPreceding, 0)
    inline = tag.isNotNull() & ~F.col("boundary") & ~F.col("in_unit") & ~tag.isin(VOID) & ~selfclose
    inner = seg.select("*", F.coalesce(inline, F.lit(False)).alias("inline")).select(
        "*", F.greatest(F.lit(0), F.sum(_sign(F.col("inline"))).over(seg_upto)).alias("nd"))
    edge = (F.col("inline") & ~closes & (F.col("nd") == 1)) | (F.col("inline") & closes & (F.col("nd") == 0))
    free_img = F.coalesce((tag == "img") & ~F.col("in_unit"), F.lit(False))
    # An image among the text of a container is a child of its own and splits that text.
    pieces = inner.select(
        "*", F.sum((edge | free_img).cast("int")).over(seg_upto).alias("piece"),
        F.max(free_img).over(Window.partitionBy(key, "seg")).alias("has_img"),
        F.sum(F.coalesce(tag == "img", F.lit(False)).cast("int")).over(
            Window.partitionBy(key, "unit").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).alias("unit_img"))
    # A segment that spans a whole container (opened before, closed after) is one paragraph. The tag
    # that starts the next segment is the last one seen from behind, so that no token row is joined.
    behind = Window.partitionBy(key).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    joined = pieces.select(
        "*", F.last(F.when(F.col("cuts"), F.struct("tag", "is_close")), ignorenulls=True).over(behind).alias("next_b"))
    leaf = (F.col("b.tag").isin([*HEADINGS, "p"]) & ~F.col("b.is_close"))
    whole = ~F.col("has_img") & ~F.col("b.is_close") & (F.col("next_b.tag") == F.col("b.tag")) & F.col("next_b.is_close")
    part = F.when(F.col("in_unit"), F.when(F.col("unit_tag").isin("ul", "ol"), F.col("item")).otherwise(0)) \
        .when(leaf | F.coalesce(whole, F.lit(False)), 0).otherwise(F.col("piece"))
    # Text elements give their text only; a figure gives its first image.
    img = F.coalesce(tag == "img", F.lit(False)) & F.when(
        F.col("in_unit"), (F.col("unit_tag") == "figure") & (F.col("unit_img") == 1)).otherwise(~F.coalesce(leaf, F.lit(False)))
    cap_depth = joined.select(
        "*", part.alias("part"), img.alias("img"),
        F.sum(_sign(F.coalesce(tag == "figcaption", F.lit(False)))).over(upto).alias("cap"),
    )
    group = (
        F.when(F.col("img"), "image")
        .when(F.col("in_unit") & (F.col("unit_tag") == "figure"), F.when(F.col("cap") > 0, "caption").otherwise("skip"))
        .when(F.col("in_unit"), F.col("unit_tag")).otherwise("text")
    )
    keyed = cap_depth.select("*", group.alias("g")).where("g <> 'skip'")
    slot = F.when(F.col("img"), F.col("pos")).when(F.col("in_unit"), F.col("unit")).otherwise(F.col("seg"))
    structured = F.col("g").isin("table", "math", "mjx-container")
    piece_text = F.when(F.col("tag").isNull(), F.struct("pos", F.col("tok").alias("t")))
    agg = keyed.withColumn("slot", slot).groupBy(key, "g", "slot", "part").agg(
        F.min("pos").alias("pos"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(piece_text)), lambda x: x["t"]), "").alias("raw"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.when(structured, F.struct("pos", "tok")))), lambda x: x["tok"]), "").alias("outer"),
        F.min_by("tok", "pos").alias("first_tok"),
        F.max(F.when((F.col("tag") == "code") & ~F.col("is_close"), F.col("tok"))).alias("code_tok"),
        F.max(F.when(leaf, F.col("b.tag"))).alias("leaf"),
    )
    return _typed(agg, key)


def latex_of(outer: Column) -> Column:
    """TeX source of a formula element: annotation, then alternative text, then math script."""
    ann = trim_space(F.regexp_extract(
        outer, r"(?is)<annotation[^>]*encoding\s*=\s*[\"']application/x-tex[\"'][^>]*>(.*?)</annotation>", 1))
    alt = F.when(outer.rlike(r"(?i)^<math"), trim_space(H.attr(F.regexp_extract(outer, r"^<[^>]*>", 0), "alttext"))).otherwise("")
    script = trim_space(F.regexp_extract(outer, r"(?is)<script[^>]*type\s*=\s*[\"']math/tex[^>]*>(.*?)</script>", 1))
    return H.decode_entities(F.coalesce(*[F.nullif(x, F.lit("")) for x in (ann, alt, script)]))


def code_language(pre_tok: Column, code_tok: Column) -> Column:
    """Language hint of a code block from a class or data attribute."""
    cls = F.coalesce(F.nullif(H.attr(code_tok, "class"), F.lit("")), H.attr(pre_tok, "class"))
    named = F.lower(F.regexp_extract(cls, r"(?i)(?:^|\s)(?:language|lang|hljs)-([\w+\-]+)", 1))
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(F.lower(H.attr(code_tok, "data-lang")), F.lit("")))


def column_count(outer: Column) -> Column:
    """Cells of the widest table row."""
    rows = F.split(outer, r"(?i)<tr\b")
    return F.array_max(F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))),
                                   lambda r: F.regexp_count(r, F.lit(r"(?i)<t[dh]\b"))))


def _typed(agg: DataFrame, key: str) -> DataFrame:
    g = F.col("g")
    is_img, is_math = g == "image", g.isin("math", "mjx-container")
    tok = F.col("first_tok")
    # Attributes first, each read once; the rules below only see plain columns.
    lazy = F.coalesce(*[F.nullif(H.attr(tok, a), F.lit("")) for a in ("data-src", "data-original", "data-lazy-src")])
    attrs = agg.select(
        key, "pos", "g", "part", "leaf", "outer",
        H.decode_entities(F.col("raw")).alias("code"),
        F.when(is_img, H.attr(tok, "src")).alias("src0"),
        F.when(is_img, lazy).alias("lazy"),
        F.when(is_img, F.concat_ws(" ", F.concat(F.lit("w"), H.attr(tok, "width")),
                                   F.concat(F.lit("h"), H.attr(tok, "height")))).alias("size"),
        F.when(is_img, F.nullif(trim_space(H.attr(tok, "alt")), F.lit(""))).alias("alt"),
        F.when(g == "pre", code_language(tok, F.col("code_tok"))).alias("language"),
        F.when(g == "table", column_count(F.col("outer"))).alias("columns"),
        F.when(is_math, latex_of(F.col("outer"))).alias("latex"),
    )
    late = (F.col("src0") == "") | F.col("src0").startswith("data:image/gif;base64,")
    sourced = attrs.select(
        "*", F.when(late, F.coalesce("lazy", "src0")).otherwise(F.col("src0")).alias("src"),
        H.collapse(F.col("code")).alias("plain"))
    one = F.col("size").rlike(r"(^w|h)1(\D|$)")
    gif = F.lower("src").rlike(r"^data:image/gif|^[^?#]*\.gif($|[?#])")
    text, payload = F.col("plain"), F.col("payload")
    typed = sourced.select(
        key, "pos", "g", "part", "leaf", "alt", "language", "columns", "plain",
        F.when(g == "ol", F.concat(F.col("part").cast("string"), F.lit(". "), text))
        .when(g == "ul", F.concat(F.lit("• "), text)).when(g == "pre", "code").when(g == "table", "table")
        .when(is_math, F.when(F.col("latex").isNotNull(), "formula").otherwise(text))
        .when(is_img, "image").otherwise(text).alias("text"),
        F.when(is_img, F.when(~one & ~gif, F.nullif("src", F.lit(""))))
        .when(g == "pre", F.when(text != "", F.col("code")))
        .when(g == "table", F.when(text != "", F.col("outer"))).when(is_math, F.col("latex")).alias("payload"),
        g.isin("ul", "ol").alias("is_list"),
    )
    kept = typed.where(
        F.when(g.isin("image", "pre", "table"), payload.isNotNull()).otherwise(F.col("text") != "")
        & ~(F.col("is_list") & (F.col("part") == 0)))
    kind = (
        F.when((g == "text") & F.col("leaf").isin(HEADINGS), "heading").when(g == "text", "paragraph")
        .when(g == "blockquote", "quote").when(g == "pre", "code").when(F.col("is_list"), "list")
        .when(is_math & payload.isNotNull(), "formula").when(is_math, "paragraph").otherwise(g)
    )
    order = Window.partitionBy(key).orderBy("pos")
    return kept.select(
        key, (F.row_number().over(order) - 1).alias("block_idx"), kind.alias("type"),
        F.when(kind == "heading", F.substring("leaf", 2, 1).cast("int")).alias("level"),
        trim_space(F.col("text")).alias("text"),
        "payload", "alt", "language", "columns",
    )


def unique_images(found: DataFrame, key: str = "page_id") -> DataFrame:
    """First use of every image source per page."""
    return found.where(F.col("type") == "image").groupBy(key, F.col("payload").alias("src")).agg(
        F.min("block_idx").alias("block_idx"))


def metadata(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Title, author, description, published date, site, language, image and domain of a page.

    Each field takes its first usable source in priority order. No shuffle.
    """
    html = F.col("html")
    metas = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)),
        lambda m: F.struct(
            F.lower(F.coalesce(F.nullif(H.attr(m, "name"), F.lit("")), H.attr(m, "property"))).alias("k"),
            H.decode_entities(H.attr(m, "content")).alias("v")))
    ld = F.regexp_extract(html, r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1)
    head = pages.select(key, "url", "html", metas.alias("metas"), ld.alias("ld"))

    def meta(name: str) -> Column:
        return F.get(F.filter("metas", lambda m: m["k"] == name), F.lit(0))["v"]

    def schema(path: str) -> Column:
        return F.get_json_object("ld", "$." + path)

    def first(*sources: Column) -> Column:
        # A value without letters or digits, or an unfilled template, is no value.
        usable = [F.when(c.rlike(r"[\p{L}\p{N}]") & ~c.rlike(r"[{}]"), trim_space(c)) for c in sources]
        return F.coalesce(*usable)

    def element(pattern: str) -> Column:
        return H.collapse(H.decode_entities(F.regexp_replace(F.regexp_extract("html", pattern, 1), "<[^>]+>", " ")))

    return head.select(
        key,
        first(meta("og:title"), meta("twitter:title"), schema("headline"), meta("title"),
              meta("sailthru.title"), element(r"(?is)<title[^>]*>(.*?)</title>")).alias("title"),
        first(meta("sailthru.author"), meta("author"), meta("byl"), schema("author.name"),
              schema("author[0].name")).alias("author"),
        first(meta("description"), meta("og:description"), schema("description"),
              meta("twitter:description"), meta("sailthru.description")).alias("description"),
        first(schema("datePublished"), meta("publishdate"), meta("article:published_time"),
              H.attr(F.regexp_extract("html", r"(?is)<time\b[^>]*>", 0), "datetime"),
              meta("sailthru.date")).alias("published"),
        first(schema("publisher.name"), meta("og:site_name"), schema("isPartOf.name"),
              meta("application-name")).alias("site"),
        first(H.attr(F.regexp_extract("html", r"(?is)<html\b[^>]*>", 0), "lang"), meta("content-language"),
              meta("og:locale"), schema("inLanguage")).alias("language"),
        first(meta("og:image"), meta("twitter:image"), schema("image.url"), meta("sailthru.image.full")).alias("image"),
        F.nullif(F.regexp_replace(H.host(F.col("url")), r"^www\.", ""), F.lit("")).alias("domain"),
    )


SCORED = ["article", "main", "section", "div", "td", "body"]


def container_scores(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Score of every content container of a page.

    Words + 10 per paragraph + commas - 3 x images per word + 15 for a content-like class - 5 per
    table, scaled down by the share of link text (at most half). Totals come from prefix sums read
    at the opening and closing tag, so no container meets its tokens as row pairs.
    """
    tag, closes = F.col("tag"), F.col("is_close")
    toks = tokens(pages.select(key, body_html(F.col("html")).alias("html")), key)
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    text = F.when(tag.isNull(), F.col("tok")).otherwise("")
    opened = lambda t: F.when((tag == t) & ~closes, 1).otherwise(0)
    in_link = F.sum(_sign(F.coalesce(tag == "a", F.lit(False)))).over(upto)
    scored_tag = F.coalesce(tag.isin(SCORED), F.lit(False))
    counted = toks.select(
        "*", in_link.alias("a"), scored_tag.alias("c"),
        F.sum(_sign(scored_tag)).over(upto).alias("d"),
    )
    n = {
        "words": F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")),
        "paras": opened("p"), "imgs": opened("img"), "tables": opened("table"),
        "commas": F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))),
        "chars": F.length(text),
        "links": F.when(F.col("a") > 0, F.length(text)).otherwise(0),
    }
    sums = counted.select("*", *[F.sum(e).over(upto).alias(f"s_{k}") for k, e in n.items()]).where("c")
    depth = F.when(closes, F.col("d") + 1).otherwise(F.col("d"))
    pair = Window.partitionBy(key, "depth").orderBy("pos")
    ends = sums.withColumn("depth", depth).select(
        "*", F.lead("is_close").over(pair).alias("closed"),
        *[F.lead(f"s_{k}").over(pair).alias(f"e_{k}") for k in n])
    t = {k: F.col(f"e_{k}") - F.col(f"s_{k}") for k in n}
    cls = F.lower(H.attr(F.col("tok"), "class"))
    words = t["words"]
    base = (
        words + 10 * t["paras"] + t["commas"] - 3.0 * t["imgs"] / F.greatest(words, F.lit(1))
        + F.when(cls.rlike("content|article|post"), 15).otherwise(0) - 5 * t["tables"]
    )
    share = F.least(t["links"] / F.greatest(t["chars"], F.lit(1)), F.lit(0.5))
    return ends.where(~closes & F.col("closed")).select(
        key, "pos", "tag", words.alias("words"), t["paras"].alias("paragraphs"),
        F.round(base * (1 - share), 6).alias("score"))


def main_container(pages: DataFrame, key: str = "page_id", floor: float = 50) -> DataFrame:
    """Best-scoring container of each page, when it scores above the floor."""
    return container_scores(pages, key).groupBy(key).agg(
        F.max_by(F.struct("pos", "tag", "score"), F.struct("score", -F.col("pos"))).alias("m")
    ).select(key, "m.*").where(F.col("score") > floor)
