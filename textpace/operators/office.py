"""Word-processor documents given as paragraph, run, style, note, relation and cell rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textpace.functions import markdown as M
from textpace.functions import web as H
from textpace.functions import words as W
from textpace.operators.ordered import running, span_bucket

# --- fixed values ---
HEADING_NAMES = ("heading{n}", "heading {n}", "заголовок {n}")
QUOTE_NAMES = ("quote", "blockquote", "intense quote", "block text")
LIST_NAMES = ("list", "bullet", "toc")
MONOSPACED = ("courier", "consolas", "monaco", "menlo", "source code pro", "sf mono", "lucida console")
# --- end of fixed values ---


def _has(text: Column, names) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.contains(text, F.lit(n))
    return out


def _level(text: Column) -> Column:
    case = F.when(F.lit(False), F.lit(0))
    for n in range(1, 7):
        case = case.when(_has(text, [v.format(n=n) for v in HEADING_NAMES]), F.lit(n))
    return case.when(F.contains(text, F.lit("subtitle")), 2).when(F.contains(text, F.lit("title")), 1)


def style_types(paras: DataFrame, styles: DataFrame) -> DataFrame:
    """Block type and level of paragraphs from style id, else style name."""
    named = paras.join(styles.select("doc_id", "style_id", "style_name"), ["doc_id", "style_id"], "left")
    return named.select(*[F.col(c) for c in paras.columns], *_style_type())


def _style_type() -> tuple[Column, Column]:
    """Type and level by style_id, else style_name."""
    sid, name = F.lower(F.coalesce("style_id", F.lit(""))), F.coalesce(F.lower("style_name"), F.lit(""))
    level = F.coalesce(_level(sid), _level(name))
    kind = (
        F.when(level.isNotNull(), "heading").when(_has(sid, QUOTE_NAMES) | _has(name, QUOTE_NAMES), "quote")
        .when(_has(sid, LIST_NAMES) | _has(name, LIST_NAMES), "list").otherwise("paragraph")
    )
    return kind.alias("type"), level.cast("int").alias("level")


def _mono(run_fonts: Column) -> Column:
    return F.forall(run_fonts, lambda f: _has(F.lower(f), MONOSPACED)) & (F.size(run_fonts) > 0)


def paragraph_blocks(paras: DataFrame, runs: DataFrame) -> DataFrame:
    """Blocks from typed paragraphs: list bullets with indent, monospaced paragraphs as code, and
    neighbouring code paragraphs merged into one block. Empty paragraphs vanish first."""
    shown = ~W.is_blank(F.col("text"))
    per_para = runs.groupBy("doc_id", "para_idx").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_idx", "text"))), lambda r: r["text"]), "").alias("raw"),
        F.coalesce(F.bool_and(F.when(shown, _mono(F.col("fonts")))), F.lit(False)).alias("mono"))
    typed = _solid(paras.join(per_para, ["doc_id", "para_idx"]))
    prev = running(typed, ["doc_id"], ["para_idx"], span_bucket("para_idx"), lasts={"_prev": F.col("type")})
    unit = running(prev.withColumn("_s", _starts()), ["doc_id"], ["para_idx"], span_bucket("para_idx"),
                   sums={"block_idx": F.col("_s")}, inclusive=True)
    return _merged(unit)


def document_blocks(paras: DataFrame) -> DataFrame:
    """``paragraph_blocks`` of paragraphs that hold their style_name and runs. A document is one row of its
    package, so plain windows serve; paragraphs move once, by document."""
    shown = F.filter("runs", lambda r: ~W.is_blank(r["text"]))
    mono = (F.size(shown) > 0) & F.forall(shown, lambda r: _mono(r["fonts"]))
    typed = _solid(paras.where(F.size("runs") > 0).select(
        "doc_id", "para_idx", "num_level", *_style_type(),
        F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("raw"), mono.alias("mono")))
    order = Window.partitionBy("doc_id").orderBy("para_idx")
    prev = typed.withColumn("_prev", F.lag("type").over(order))
    return _merged(prev.withColumn("block_idx", F.sum(_starts()).over(order.rowsBetween(Window.unboundedPreceding, 0))))


def _solid(paras: DataFrame) -> DataFrame:
    """Paragraphs with text, with their final type, level and text."""
    text = H.collapse(F.col("raw"))
    numbered = F.coalesce(F.col("num_level").isNotNull(), F.lit(False))
    kind = F.when(numbered, "list").otherwise(F.col("type"))
    return paras.select(
        "doc_id", "para_idx", F.when((kind == "paragraph") & F.col("mono"), "code").otherwise(kind).alias("type"),
        F.when(kind == "heading", F.col("level")).alias("level"),
        F.when(kind == "list", F.concat(F.expr("repeat('  ', coalesce(num_level, 0))"), F.lit("• "), text))
        .otherwise(text).alias("text")).where(text != "")


def _starts() -> Column:
    """A code paragraph starts a block unless the paragraph before it is code as well."""
    return F.when((F.col("type") == "code") & (F.coalesce(F.col("_prev"), F.lit("")) == "code"), 0).otherwise(1)


def _merged(unit: DataFrame) -> DataFrame:
    """Paragraphs of one block_idx, which counts from 1, as one block."""
    return unit.groupBy("doc_id", (F.col("block_idx") - 1).alias("block_idx"), "type").agg(
        F.first("level").alias("level"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_idx", "text"))), lambda r: r["text"]), "\n").alias("body"),
    ).select(
        "doc_id", "block_idx", "type", "level",
        F.when(F.col("type") == "code", "code").otherwise(F.col("body")).alias("text"),
        F.when(F.col("type") == "code", F.col("body")).alias("payload"))


def footnote_blocks(notes: DataFrame, refs: DataFrame) -> DataFrame:
    """Notes that the body refers to, as "[id] text"; ids 0 and 1 are separators."""
    used = refs.where(~F.col("note_id").isin("0", "1")).select("doc_id", "note_id").distinct()
    return notes.join(used, ["doc_id", "note_id"], "left_semi").select(
        "doc_id", "note_id", H.collapse(F.col("text")).alias("_t")).where("_t <> ''").select(
        "doc_id", "note_id", F.concat(F.lit("["), F.col("note_id"), F.lit("] "), F.col("_t")).alias("text"))


def embedded_images(uses: DataFrame, rels: DataFrame, media: DataFrame) -> DataFrame:
    """Images of a document resolved by relation id to a stored media file."""
    return (
        uses.join(rels, ["doc_id", "rel_id"])
        .select("doc_id", "para_idx", "rel_id", F.regexp_replace("target", r"^\./", "").alias("path"))
        .join(media.select("doc_id", "path"), ["doc_id", "path"], "left_semi"))


def tables(cells: DataFrame) -> DataFrame:
    """One table block per table: blank rows dropped, first row as header, widest row counted."""
    rows = cells.groupBy("doc_id", "table_idx", "row_idx").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("cell_idx", "text"))), lambda c: c["text"]).alias("r"))
    return _html(rows.where(F.exists("r", _filled)).groupBy("doc_id", "table_idx").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "r"))), lambda x: x["r"]).alias("rows")))


def document_tables(found: DataFrame) -> DataFrame:
    """``tables`` of tables that hold their rows and those their cells, both in order: no row of a cell, and none moves."""
    solid = F.filter(F.transform("rows", lambda r: F.transform(r["cells"], lambda c: c["text"])), lambda r: F.exists(r, _filled))
    # Exploded from an array of one, so that the filter below does not work the rows out a second time.
    kept = found.select("doc_id", "table_idx", F.explode(F.array(solid)).alias("rows"))
    return _html(kept.where(F.size("rows") > 0))


def _filled(cell: Column) -> Column:
    return ~W.is_blank(cell)


def _html(grouped: DataFrame) -> DataFrame:
    """doc_id, table_idx, columns and html from rows, an array of arrays of cell texts."""
    def row(r: Column, tag: str) -> Column:
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(
            r, lambda c: F.concat(F.lit(f"<{tag}>"), M.escape_html(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))

    head = row(F.get("rows", F.lit(0)), "th")
    body = F.array_join(F.transform(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))), lambda r: row(r, "td")), "")
    return grouped.select(
        "doc_id", "table_idx", F.array_max(F.transform("rows", F.size)).alias("columns"),
        F.concat(F.lit("<table><thead>"), head, F.lit("</thead><tbody>"), body, F.lit("</tbody></table>")).alias("html"))
