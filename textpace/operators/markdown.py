"""Markdown documents to blocks, outlines and references.

A document is one row, so its line list is bounded by that row; rows are placed by key before
lines are exploded and every window below reuses that placement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textpace.functions import markdown as M
from textpace.functions import words as W
from textpace.operators.ordered import by_key

# --- fixed values: line patterns ---
FENCE = r"^(```|~~~)"
ABBR = r"^\*\[([^\]]+)\]:[ \t]+(.+)$"
DEF = r"^[ ]{0,3}:[ \t]+(.+)$"
NOTE_DEF = r"^\[\^([^\]\n]+)\]:[ \t]*(.*)$"
# --- end of fixed values ---


def scan_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Stateless line scan: kind (paragraph, heading, skipped), level and plain text."""
    lines = docs.select(key, F.posexplode(F.split("text", M.NEWLINES)).alias("line_idx", "line"))
    return _scanned(lines, key)


def _scanned(lines: DataFrame, key: str) -> DataFrame:
    line, t = F.col("line"), W.trim_space(F.col("line"))
    is_row = t.startswith("|")
    skipped = (
        line.startswith("```") | t.rlike(r"^(-{3,}|\*{3,}|_{3,})$")
        | (is_row & t.rlike(r"^\|[\s\-:|]+\|$"))
    )
    hashes = F.length(F.regexp_extract(t, r"^(#*)", 1))
    heading = ~is_row & hashes.between(1, 6) & t.rlike(r"^#{1,6}[ \t]")
    cells = F.filter(F.transform(F.split(t, r"\|"), W.trim_space), lambda c: c != "")
    return lines.select(
        *lines.columns,
        F.when(skipped, "skipped").when(heading, "heading").otherwise("paragraph").alias("kind"),
        F.when(~skipped & heading, hashes).alias("level"),
        F.when(skipped, "").when(is_row, F.array_join(cells, " "))
        .otherwise(M.apply_rules(line, M.SCAN_RULES)).alias("plain"),
    )


def scanned_plain_text(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Plain text through the line scanner; each table becomes one placeholder word."""
    lines = by_key(docs.select(key, "text"), key).select(
        key, F.posexplode(F.split("text", M.NEWLINES)).alias("line_idx", "line"))
    w = Window.partitionBy(key).orderBy("line_idx")
    pipe = M.has_pipe(F.col("line"))
    row = pipe & ~W.is_blank(F.col("line"))
    next_sep = F.coalesce(F.lead(M.is_scan_separator(F.col("line"))).over(w), F.lit(False))
    flagged = lines.select("*", row.alias("row"), (pipe & next_sep).alias("head"))
    tagged = _with_tables(flagged, key)
    kept = _scanned(tagged, key).where(
        F.col("in_table") & (F.col("line_idx") == F.col("table_at"))
        | ~F.col("in_table") & (F.col("kind") != "skipped")
    )
    text = F.when(F.col("in_table"), "table").otherwise(F.col("plain"))
    return kept.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("line_idx", text.alias("t")))).alias("parts")
    ).select(
        key,
        W.trim_space(F.array_join(F.transform("parts", lambda p: p["t"]), "\n")).alias("plain_text"),
    )


def _with_tables(lines: DataFrame, key: str) -> DataFrame:
    """Mark table lines. Needs line_idx, row (a pipe line) and head (a possible table header).

    A table holds its header, the separator and the pipe lines that follow at once; a possible
    header inside an earlier table is one of its rows. Lines fall into groups, each a line without
    a pipe and the pipe lines after it, so only the first header of a group can count, and a table
    leaves its group only where that header ends it: then the next group, from its separator on,
    is rows of the table. Every second group of a chain of such headers is therefore rows.
    """
    w = Window.partitionBy(key).orderBy("line_idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    row, head, idx = F.col("row"), F.col("head"), F.col("line_idx")
    grouped = lines.select(
        "*", F.sum((~row).cast("int")).over(upto).alias("_g"),
        F.coalesce(F.max(F.when(~row, idx)).over(upto), F.lit(-1)).alias("_from"),
        F.coalesce(F.max(F.when(head, idx)).over(before), F.lit(-2)).alias("_seen"),
        (~F.coalesce(F.lead("row").over(w), F.lit(False))).alias("_last"),
        F.when(F.first("row").over(upto), -1).otherwise(0).alias("_none"))
    first = head & (F.col("_seen") < F.col("_from"))
    chained = grouped.select("*", first.alias("_first")).select(
        "*", F.coalesce(F.max(F.when(F.col("_last") & ~F.col("_first"), F.col("_g"))).over(before), F.col("_none")).alias("_unlinked"),
        F.coalesce(F.max(F.when(F.col("_first"), idx)).over(upto), F.lit(-2)).alias("_head"))
    rows_only = (F.col("_g") > 0) & ((F.col("_g") - 1 - F.col("_unlinked")) % 2 == 1)
    own = (F.col("_head") >= 0) & (F.col("_head") >= F.col("_from"))
    inside = rows_only | own
    return chained.select(
        *[F.col(c) for c in lines.columns], inside.alias("in_table"),
        F.when(rows_only, F.col("_from") - 1).when(own, F.col("_head")).alias("table_at"))


# Delimiter lines of a span of the delimiter scan.
SPAN = 64


def _step(mode: Column, mark: Column) -> Column:
    """Mode after a delimiter: 0 prose, 1 in a fence, 2 in a formula."""
    fence = mark["k"] == "f"
    return (
        F.when(fence & (mode < 2), 1 - mode).when(~fence & (mode == 2), 0)
        .when(~fence & (mode == 0) & mark["paired"], 2).otherwise(mode))


def _role(mode: Column, after: Column) -> Column:
    return (
        F.when((mode == 0) & (after == 1), "fence_open").when((mode == 1) & (after == 0), "fence_close")
        .when((mode == 0) & (after == 2), "math_open").when((mode == 2) & (after == 0), "math_close"))


def _line_roles(lines: Column) -> Column:
    """Role of every line: null, or how a fence or formula delimiter counts.

    Inside a fence only a fence line counts, inside a formula only a formula line; a formula
    delimiter without a later partner is prose. A scan over spans of delimiters: each span is
    reduced to where it leads from every mode, those maps are composed in order, and each span
    then runs once from its true mode. The result has one entry a line, so no line looks any up.
    """
    found = F.filter(
        F.transform(lines, lambda l, i: F.struct(
            i.alias("idx"),
            F.when(W.trim_space(l).rlike(FENCE), "f").when(W.trim_space(l) == "$$", "d").alias("k"))),
        lambda m: m["k"].isNotNull())

    def spans(marks: Column) -> Column:
        last = F.coalesce(
            F.array_max(F.transform(F.filter(marks, lambda m: m["k"] == "d"), lambda m: m["idx"])), F.lit(-1))
        known = F.transform(marks, lambda m: F.struct(m["idx"].alias("idx"), m["k"].alias("k"), (m["idx"] < last).alias("paired")))
        return W.let(known, lambda ms: F.transform(
            F.sequence(F.lit(1), F.size(ms), F.lit(SPAN)), lambda at: F.slice(ms, at, SPAN)))

    def modes(parts: Column) -> Column:
        ends = F.transform(parts, lambda part: F.transform(
            F.array(F.lit(0), F.lit(1), F.lit(2)), lambda mode: F.aggregate(part, mode, _step)))
        return F.aggregate(ends, F.array(F.lit(0)), lambda s, e: F.concat(
            s, F.array(F.get(e, F.try_element_at(s, F.lit(-1))))))

    def run(part: Column, mode: Column) -> Column:
        state = F.expr("cast(named_struct('mode', 0, 'roles', array()) as struct<mode:int,roles:array<string>>)")

        def step(s: Column, m: Column) -> Column:
            after = _step(s["mode"], m)
            return F.struct(after.alias("mode"), F.concat(s["roles"], F.array(_role(s["mode"], after))).alias("roles"))

        return F.aggregate(part, state.withField("mode", mode), step, lambda s: s["roles"])

    none = F.lit(None).cast("string")

    def spread(marks: Column) -> Column:
        """Roles of the delimiters with nulls for the lines between them."""
        roles = W.let(spans(marks), lambda parts: W.let(modes(parts), lambda at: F.flatten(
            F.transform(parts, lambda part, i: run(part, F.get(at, i))))))
        return W.let(roles, lambda rs: F.concat(
            F.array_repeat(none, F.get(marks, F.lit(0))["idx"]),
            F.flatten(F.transform(marks, lambda m, i: F.concat(
                F.array(F.get(rs, i)),
                F.array_repeat(none, F.coalesce(F.get(marks, i + 1)["idx"], F.size(lines)) - m["idx"] - 1))))))

    return W.let(found, lambda marks: F.when(F.size(marks) > 0, spread(marks)).otherwise(
        F.array_repeat(none, F.size(lines))))


def classify_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every line with its class and the unit (block) it belongs to."""
    split = by_key(docs.select(key, "text"), key).select(key, F.split("text", "\n").alias("lines"))
    lines = split.select(
        key, F.posexplode(F.arrays_zip("lines", _line_roles(F.col("lines")).alias("roles"))).alias("line_idx", "_l")
    ).select(key, "line_idx", F.col("_l.lines").alias("line"), W.trim_space(F.col("_l.lines")).alias("t"),
             F.col("_l.roles").alias("role"))
    w = Window.partitionBy(key).orderBy("line_idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    line, t = F.col("line"), F.col("t")
    in_region = F.last(F.col("role"), ignorenulls=True).over(upto)
    region_at = F.last(F.when(F.col("role").isNotNull(), F.col("line_idx")), ignorenulls=True).over(upto)
    kind = (
        F.when(t == "", "blank")
        .when(line.rlike(r"^#{1,6} "), "heading")
        .when(t.rlike(r"^={2,}$"), "under1")
        .when(t.rlike(r"^-{2,}$"), "under2")
        .when(t.rlike(r"^(\*{3,}|_{3,})$"), "rule")
        .when(t.startswith("$$") & t.endswith("$$") & (F.length(t) > 4), "formula")
        .when(t.rlike(r"^\[\^[^\]]+\]:"), "note")
        .when(t.startswith(">"), "quote")
        .when(t.rlike(r"^[-*+] |^\p{Nd}+\.\s+"), "list")
        .otherwise("prose")
    )
    staged = lines.select(
        "*", in_region.alias("_in"), region_at.alias("_at"), kind.alias("kind"),
        F.lead("t").over(w).alias("_next"),
    )
    free = F.coalesce(F.col("_in").isin("fence_close", "math_close"), F.lit(True)) & F.col("role").isNull()
    # A header needs a separator on the next line; unequal cell counts still end a paragraph.
    opens = free & (F.col("kind") == "prose") & M.has_pipe(t) & F.coalesce(M.is_separator(F.col("_next")), F.lit(False))
    equal = F.size(M.row_cells(t)) == F.size(M.row_cells(F.col("_next")))
    flagged = staged.select(
        "*", free.alias("_free"), opens.alias("_opens"),
        (opens & equal & (F.size(M.row_cells(t)) > 0)).alias("head"),
        ((t != "") & M.has_pipe(t)).alias("row"),
    )
    tagged = _with_tables(flagged, key)
    cls = (
        F.when(F.col("in_table"), "table")
        .when(F.col("_in").isin("fence_open", "fence_close") & ~F.col("_free"), "code")
        .when(F.col("_in").isin("math_open", "math_close") & ~F.col("_free"), "math")
        .otherwise(F.col("kind"))
    )
    done = tagged.withColumn("cls", cls)
    # A formula mark without a partner is prose, yet it ends the paragraph before it.
    lone = (F.col("t") == "$$") & (F.col("cls") == "prose")
    breaks = ~F.col("cls").isin("prose", "note", "under1", "under2") | lone | (
        F.col("_opens") & ~F.col("in_table"))
    under = F.col("cls").isin("under1", "under2")
    # An underline closes the paragraph before it, so it counts from the next line on.
    group = (
        F.sum(breaks.cast("int")).over(upto)
        + F.sum(under.cast("int")).over(upto) - under.cast("int")
    )
    open_at = F.last(
        F.when(F.col("role").isin("fence_open", "math_open"), F.col("line_idx")), ignorenulls=True
    ).over(upto)
    unit = (
        F.when(F.col("cls") == "table", F.col("table_at"))
        .when(F.col("cls").isin("code", "math"), open_at)
        .when(F.col("cls").isin("prose", "under1", "under2"), group)
        .otherwise(F.col("line_idx"))
    )
    family = (
        F.when(F.col("cls").isin("prose", "under1", "under2"), "paragraph").otherwise(F.col("cls"))
    )
    return done.select(key, "line_idx", "line", "t", "role", "cls", family.alias("family"), unit.alias("unit"), "table_at")


def parse_blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Typed blocks: key, block_idx, line_idx, type, level, text, language, payload, columns."""
    lines = classify_lines(docs, key).where(~F.col("cls").isin("blank", "rule", "note"))
    text = F.when(F.col("cls").isin("code", "math"), F.col("line")).when(
        F.col("cls") == "prose", M.strip_inline(F.col("t"))).otherwise(F.col("t"))
    body = F.col("role").isNull() & ~F.col("cls").isin("under1", "under2") & (
        (F.col("cls") != "prose") | (text != ""))
    units = lines.groupBy(key, "family", "unit").agg(
        F.min("line_idx").alias("line_idx"),
        F.sort_array(F.collect_list(F.when(body, F.struct("line_idx", text.alias("s"))))).alias("parts"),
        F.max(F.when(F.col("cls") == "under1", 1).when(F.col("cls") == "under2", 2)).alias("under"),
        F.max(F.when(F.col("role") == "fence_open", F.col("t"))).alias("opening"),
    ).withColumn("rows", F.transform("parts", lambda p: p["s"]))
    fam, first = F.col("family"), F.get("rows", F.lit(0))
    joined = W.trim_space(F.array_join("rows", " "))
    raw = W.trim_space(F.array_join("rows", "\n"))
    hashes = F.length(F.regexp_extract(first, r"^(#+)", 1))
    title = F.regexp_replace(W.trim_space(F.regexp_replace(first, r"^#+", "")), r"\s+#+\s*$", "")
    quote = M.strip_inline(W.trim_space(F.substring(first, F.lit(2), F.length(first))))
    item = M.strip_inline(F.regexp_replace(first, r"^(?:[-*+] (?:\[[ xX]\] )?|\p{Nd}+\.\s+)", ""))
    one_line = F.regexp_replace(first, r"^\$\$|\$\$$", "")
    width = F.size(M.row_cells(first))

    def html_row(cells: Column, tag: str) -> Column:
        return F.concat(
            F.lit("<tr>"),
            F.array_join(F.transform(cells, lambda c: F.concat(
                F.lit(f"<{tag}>"), M.escape_html(M.strip_inline(c)), F.lit(f"</{tag}>"))), ""),
            F.lit("</tr>"),
        )

    def fitted(row: Column) -> Column:
        cells = M.row_cells(row)
        return F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), 1, width)

    html = F.concat(
        F.lit("<table><thead>"), html_row(M.row_cells(first), "th"), F.lit("</thead><tbody>"),
        F.array_join(F.transform(F.slice("rows", 3, F.greatest(F.size("rows"), F.lit(1))),
                                 lambda r: html_row(fitted(r), "td")), ""),
        F.lit("</tbody></table>"),
    )
    language = F.lower(W.trim_space(F.substring(F.col("opening"), F.lit(4), F.length("opening"))))
    shown = (
        F.when(fam == "paragraph", F.when(F.size("rows") > 0, joined).otherwise(""))
        .when(fam == "heading", M.strip_inline(title)).when(fam == "quote", quote)
        .when(fam == "list", item).when(fam == "code", "code").when(fam == "table", "table")
        .otherwise("formula")
    )
    # Exploded from an array of one, so that the filter below does not work the text out a second time.
    built = units.select("*", F.explode(F.array(shown)).alias("text")).select(
        key, "line_idx", "family",
        F.when((fam == "paragraph") & F.col("under").isNotNull(), "heading")
        .when(fam == "math", "formula").otherwise(fam).alias("type"),
        F.when(fam == "heading", hashes).when(fam == "paragraph", F.col("under")).alias("level"),
        "text",
        F.when(fam == "code", F.nullif(language, F.lit(""))).alias("language"),
        F.when(fam == "code", raw).when(fam == "math", raw)
        .when(fam == "formula", W.trim_space(one_line)).when(fam == "table", html).alias("payload"),
        F.when(fam == "table", width).alias("columns"),
    )
    # A written heading may be empty; an underline with no paragraph before it is a rule.
    solid = (
        F.when(F.col("type").isin("code", "formula"), F.col("payload") != "")
        .when(F.col("family") == "heading", F.lit(True)).otherwise(F.col("text") != ""))
    kept = built.where(solid).drop("family")
    order = Window.partitionBy(key).orderBy("line_idx")
    return kept.select(key, (F.row_number().over(order) - 1).alias("block_idx"), *kept.columns[1:])


def rendered_blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks with n_words and word_offset, the place of their first word in the document.

    The blocks of a document come from one row, so a plain window reuses the placement of that row.
    """
    counted = parse_blocks(docs, key).withColumn("n_words", W.word_count(F.col("text")))
    before = Window.partitionBy(key).orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("word_offset", F.coalesce(F.sum("n_words").over(before), F.lit(0)))


def markdown_outline(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Flat outline through the line scanner, with word positions of the scanned stream."""
    lines = by_key(docs.select(key, "text"), key).select(
        key, F.posexplode(F.split("text", M.NEWLINES)).alias("line_idx", "line"))
    scanned = _scanned(lines, key).where(F.col("kind") != "skipped").select(
        "*", W.word_count(F.col("plain")).alias("n"), W.trim_space(F.col("plain")).alias("title"))
    w = Window.partitionBy(key).orderBy("line_idx")
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    offs = scanned.select("*", (F.sum("n").over(before) - F.col("n")).alias("word_idx"))
    return offs.where((F.col("kind") == "heading") & (F.col("title") != "")).select(
        key, (F.row_number().over(w) - 1).alias("toc_idx"), F.lit(None).cast("int").alias("block_idx"),
        "level", "title", "word_idx",
    )


def formulas(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Formulas in reading order; code and escapes win, prices are not formulas."""
    hits = F.regexp_extract_all("text", F.lit(f"{M.CODE}|{M.FORMULA}"), F.lit(0))
    found = F.filter(
        hits, lambda h: h.rlike(r"^(?s:\$.*\$|\\\(.*\\\)|\\\[.*\\\])$"))
    rows = docs.select(key, F.posexplode(found).alias("formula_idx", "raw"))
    wide = F.col("raw").rlike(r"^(?:\$\$|\\)")
    n = F.when(wide, 2).otherwise(1)
    return rows.select(
        key, "formula_idx",
        F.substring(F.col("raw"), n + 1, F.length("raw") - 2 * n).alias("latex"),
        F.col("raw").rlike(r"^(?:\$\$|\\\[)").alias("display"),
    )


def abbreviations(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Uses of defined abbreviations outside code, in order, with their expansion."""
    fence = r"^[ \t]*(`{3,}|~{3,})"
    # Fences are counted at definitions only, from the few places where fences are.
    flagged = F.transform(F.split("text", "\n"), lambda l: F.struct(
        l.alias("line"), l.rlike(ABBR).alias("d"), l.rlike(fence).alias("f")))
    at = lambda ls: F.filter(F.transform(ls, lambda x, i: F.when(x["f"], i)), lambda i: i.isNotNull())
    marked = W.let(flagged, lambda ls: W.let(at(ls), lambda fences: F.transform(ls, lambda x, i: F.struct(
        x["line"].alias("line"),
        (x["d"] & (F.size(F.filter(fences, lambda f: f <= i)) % 2 == 0)).alias("d"),
        x["f"].alias("f")))))
    has_def = docs.where(F.col("text").rlike("(?m)" + ABBR)).select(key, marked.alias("ls"))
    defs = F.transform(
        F.filter("ls", lambda x: x["d"]),
        lambda x: F.struct(F.regexp_extract(x["line"], ABBR, 1).alias("k"),
                           F.regexp_extract(x["line"], ABBR, 2).alias("v")))
    body = F.array_join(F.transform(F.filter("ls", lambda x: ~x["d"]), lambda x: x["line"]), "\n")
    keyed = has_def.select(key, body.alias("body"), defs.alias("defs")).where(F.size("defs") > 0)
    names = F.array_distinct(F.transform("defs", lambda d: d["k"]))
    longest = F.transform(
        F.array_sort(F.transform(names, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))),
        lambda s: F.regexp_replace(s["k"], r"[.*+?^${}()|\[\]\\]", r"\\$0"))
    pattern = F.concat(F.lit(r"\b("), F.array_join(longest, "|"), F.lit(r")\b"))
    uses = W.let(pattern, lambda pat: F.flatten(F.transform(
        M.code_segments(F.col("body")),
        lambda s, i: F.when(i % 2 == 0, F.regexp_extract_all(s, pat, F.lit(1)))
        .otherwise(F.array().cast("array<string>")))))
    return keyed.select(key, "defs", F.posexplode(uses).alias("use_idx", "term")).select(
        key, "use_idx", "term",
        # A later definition of the same term wins.
        F.element_at(F.filter("defs", lambda d: d["k"] == F.col("term")), -1)["v"].alias("expansion"),
    )


def definition_lists(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Terms and their definitions; unindented lines right after a definition continue it.

    One fold over a document's lines; rows are added only at definition and continuation lines.
    """
    state = (
        "struct<mode:int,fence:boolean,cand:int,term:int,def:int,"
        "rows:array<struct<term:int,def:int,line:int>>>"
    )
    cls = F.transform(
        F.split("text", "\n"),
        lambda l, i: F.struct(
            i.alias("i"),
            F.when(l.rlike(r"^[ \t]*(`{3,}|~{3,})"), "fence").when(W.trim_space(l) == "", "blank")
            .when(l.rlike(DEF), "def").when(l.rlike(r"^\s"), "indent")
            .when(l.rlike(r"^[#>*+\-]\s|^\d+\.\s|^[ ]{0,3}:[ \t]|^---+$"), "struct")
            .otherwise("plain").alias("c"),
        ),
    )

    def step(s: Column, x: Column) -> Column:
        c, i = x["c"], x["i"]
        absorbing = s["mode"] == 1
        outside = ~absorbing & ~s["fence"]
        starts = outside & (c == "def") & (s["cand"] >= 0)
        more = absorbing & (c == "def")
        cont = absorbing & c.isin("plain", "struct", "fence")
        term = F.when(starts, s["cand"]).otherwise(s["term"])
        d = F.when(starts | more, i).otherwise(s["def"])
        return F.struct(
            F.when(starts | more | cont, 1).otherwise(0).alias("mode"),
            F.when(~absorbing & (c == "fence"), ~s["fence"]).otherwise(s["fence"]).alias("fence"),
            F.when(outside & (c == "plain"), i)
            .when(outside & (c == "blank"), s["cand"]).otherwise(-1).alias("cand"),
            term.alias("term"), d.alias("def"),
            F.when(starts | more | cont, F.concat(s["rows"], F.array(
                F.struct(term.alias("term"), d.alias("def"), i.alias("line")))))
            .otherwise(s["rows"]).alias("rows"),
        )

    zero = F.expr(
        f"cast(named_struct('mode', 0, 'fence', false, 'cand', -1, 'term', -1, 'def', -1, 'rows', array()) as {state})")
    folded = docs.select(key, F.split("text", "\n").alias("lines"),
                         F.aggregate(cls, zero, step, lambda s: s["rows"]).alias("rows"))
    texts = F.transform("rows", lambda r: F.struct(
        r["term"].alias("term_line"), r["def"].alias("def_line"), r["line"].alias("line"),
        W.trim_space(F.element_at("lines", r["term"] + 1)).alias("term"),
        F.when(r["def"] == r["line"],
               F.regexp_extract(F.element_at("lines", r["line"] + 1), DEF, 1))
        .otherwise(W.trim_space(F.element_at("lines", r["line"] + 1))).alias("s")))
    return folded.select(key, F.explode(texts).alias("r")).select(key, "r.*").groupBy(key, "term_line", "def_line", "term").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "s"))), lambda t: t["s"]), " ").alias("definition"))


def footnotes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Footnote references that have a definition, numbered by first use; repeats allowed."""
    lines = F.split("text", "\n")
    defs = F.transform(
        F.filter(lines, lambda l: l.rlike(NOTE_DEF)),
        lambda l: F.struct(F.regexp_extract(l, NOTE_DEF, 1).alias("k"), F.regexp_extract(l, NOTE_DEF, 2).alias("v")))
    body = F.array_join(F.filter(lines, lambda l: ~l.rlike(NOTE_DEF)), "\n")
    ready = docs.select(key, defs.alias("defs"), body.alias("body"))
    found = F.flatten(F.transform(
        M.code_segments(F.col("body")),
        lambda s, i: F.when(i % 2 == 0, F.regexp_extract_all(s, F.lit(r"\[\^([^\]\n]+)\]"), F.lit(1)))
        .otherwise(F.array().cast("array<string>"))))
    refs = W.let(F.transform("defs", lambda d: d["k"]),
                 lambda known: F.filter(found, lambda r: F.array_contains(known, r)))
    used = ready.select(key, "defs", refs.alias("refs"))
    return used.select(
        key, "defs", F.array_distinct("refs").alias("order"), F.posexplode("refs").alias("ref_idx", "label")
    ).select(
        key, "ref_idx", "label",
        F.array_position("order", F.col("label")).cast("int").alias("number"),
        F.filter("defs", lambda d: d["k"] == F.col("label"))[0]["v"].alias("content"),
    )


CONTAINER = r"(?m)^:::[ \t]*([\w-]+)[ \t]*\n((?s:.*?))\n:::[ \t]*$"


def containers(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Named containers with their content."""
    pairs = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(CONTAINER), F.lit(1)).alias("name"),
        F.regexp_extract_all("text", F.lit(CONTAINER), F.lit(2)).alias("content"))
    return docs.select(key, F.posexplode(pairs).alias("container_idx", "c")).select(
        key, "container_idx", "c.name", "c.content")


def code_parts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Prose and code segments of a text, in order."""
    return docs.select(key, F.posexplode(M.code_segments(F.col("text"))).alias("seg_idx", "segment")).select(
        key, "seg_idx", (F.col("seg_idx") % 2 == 1).alias("is_code"), "segment").where(F.col("segment") != "")
