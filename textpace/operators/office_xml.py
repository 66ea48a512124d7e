"""Word-processor documents from the XML members of their packages to relational rows.

``members`` has doc_id, path and content (text; null for binary members). A member is one row, so
its tokens and every window below are bounded by that row. Members are placed by document before
they are cut into tokens, and all groupings by document reuse that placement. The body, whose table
cells are many times the text, is walked by a small Arrow function that emits only what is kept. Missing, null and empty members
give no rows; of members that repeat a path the greatest content counts.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from textpace.functions import web as H
from textpace.functions import xml as X
from textpace.operators.ordered import by_key
from textpace.session import guard

# --- fixed values: members and font attributes of the format ---
BODY, STYLES, NOTES = "word/document.xml", "word/styles.xml", "word/footnotes.xml"
RELATIONS, FOLDER = "word/_rels/document.xml.rels", "word/"
FONTS = ("ascii", "hAnsi", "eastAsia", "cs")
# --- end of fixed values ---


def _member(members: DataFrame, path: str) -> DataFrame:
    guard(members.sparkSession)
    return by_key(members.where(F.col("path") == path).select("doc_id", "content"), "doc_id").groupBy("doc_id").agg(F.max("content").alias("content"))


def _wanted(toks: Column, names: tuple[str, ...], text: bool) -> Column:
    """Tags of the names, and text where asked for, as structs of pos and tok, so that no other token becomes a row.

    The pattern may let a tag of another name through; ``name`` tells it apart later.
    """
    tag = rf"^</?(?:[^\s/>:]+:)?(?iu:{'|'.join(names)})(?![^\s/>:?!])"
    shown = lambda t: t.rlike(tag) | (~t.startswith("<") | t.startswith("<![CDATA[")) if text else t.rlike(tag)
    return F.filter(F.transform(toks, lambda t, i: F.struct(i.alias("pos"), t.alias("tok"))), lambda x: shown(x["tok"]))


def _tags(members: DataFrame, path: str, *names: str, text: bool = False) -> DataFrame:
    """Tokens of one member: doc_id, pos, tok, name (null for text), closes, empty."""
    return _described(_member(members, path).select("doc_id", F.inline(_wanted(X.tokens(F.col("content")), names, text))))


def _described(toks: DataFrame) -> DataFrame:
    return toks.where(~F.col("tok").startswith("<!--")).select(
        *toks.columns, X.local_name(F.col("tok")).alias("name"),
        F.col("tok").startswith("</").alias("closes"), F.col("tok").endswith("/>").alias("empty"))


def _opens(*names: str) -> Column:
    return F.coalesce(F.col("name").isin(*names), F.lit(False)) & ~F.col("closes")


def _depth(name: str, w) -> Column:
    """Open elements of a name. An element without content opens nothing."""
    sign = F.when(F.col("empty"), 0).when(F.col("closes"), -1).otherwise(1)
    return F.sum(F.when(F.col("name") == name, sign).otherwise(0)).over(w)


def _ordered(*keys: str):
    return Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def styles(members: DataFrame) -> DataFrame:
    """doc_id, style_id, style_name. Of repeated ids, and of names in one style, the last counts."""
    upto = _ordered("doc_id")
    toks = _tags(members, STYLES, "style", "name")
    inside = toks.select(
        "*", _depth("style", upto).alias("in_style"),
        F.last(F.when(_opens("style"), F.struct("pos", X.attribute(F.col("tok"), "styleId").alias("id"))), ignorenulls=True)
        .over(upto).alias("style"))
    named = inside.where((F.col("in_style") > 0) & _opens("name")).select(
        "doc_id", "pos", F.col("style.id").alias("style_id"), X.attribute(F.col("tok"), "val").alias("style_name"))
    return named.where(F.col("style_id").isNotNull() & F.col("style_name").isNotNull()).groupBy("doc_id", "style_id").agg(
        F.max_by("style_name", "pos").alias("style_name"))


def notes(members: DataFrame) -> DataFrame:
    """doc_id, note_id, text of every note; text of a repeated id is that of its last element."""
    upto = _ordered("doc_id")
    inside = _tags(members, NOTES, "footnote", "t", text=True).select(
        "*", _depth("footnote", upto).alias("in_note"), _depth("t", upto).alias("in_text"),
        F.sum(_opens("footnote").cast("int")).over(upto).alias("n"),
        F.last(F.when(_opens("footnote"), F.struct(X.attribute(F.col("tok"), "id").alias("id"))), ignorenulls=True)
        .over(upto)["id"].alias("note_id"))
    texts = inside.where((F.col("in_note") > 0) & F.col("note_id").isNotNull()).groupBy("doc_id", "note_id", "n").agg(
        _joined(F.when(F.col("in_text") > 0, X.text_of(F.col("tok")))).alias("text"))
    return texts.groupBy("doc_id", "note_id").agg(F.max_by("text", "n").alias("text"))


def relations(members: DataFrame) -> DataFrame:
    """doc_id, rel_id, target; of repeated ids the last counts."""
    tags = _tags(members, RELATIONS, "relationship").where(_opens("relationship")).select(
        "doc_id", "pos", X.attribute(F.col("tok"), "Id").alias("rel_id"), X.attribute(F.col("tok"), "Target").alias("target"))
    return tags.where(F.col("rel_id").isNotNull() & F.col("target").isNotNull()).groupBy("doc_id", "rel_id").agg(
        F.max_by("target", "pos").alias("target"))


def media(members: DataFrame) -> DataFrame:
    """doc_id and path, relative to the folder of the body, of the stored files."""
    return members.where(F.col("path").startswith(FOLDER)).select(
        "doc_id", F.substring("path", F.lit(len(FOLDER) + 1), F.length("path")).alias("path")).distinct()


def _joined(text: Column) -> Column:
    return F.array_join(F.transform(
        F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct("pos", text.alias("s"))))), lambda x: x["s"]), "")


# A token of a body paragraph, with what was open around it.
_INT, _LONG, _TEXT, _FLAG = T.IntegerType(), T.LongType(), T.StringType(), T.BooleanType()
PIECE = T.StructType([T.StructField(n, t) for n, t in (
    ("pos", _INT), ("tok", _TEXT), ("para_idx", _LONG), ("run_idx", _LONG), ("in_ppr", _FLAG), ("in_r", _FLAG),
    ("in_rpr", _FLAG), ("in_text", _FLAG))])
_TEXTS = T.ArrayType(_TEXT)


def _rows_of(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields.items()]))


# Paragraphs of a body that say something. ``levels`` and ``fonts`` are attribute values as they stand.
PARAGRAPHS = _rows_of(
    para_idx=_LONG, style_id=_TEXT, levels=_TEXTS, numbered=_FLAG, said=_FLAG,
    runs=_rows_of(run_idx=_LONG, text=_TEXT, fonts=_TEXTS))
# Tables of a body: their rows in order, each the texts of its cells.
TABLES = _rows_of(table_idx=_LONG, rows=_rows_of(row_idx=_LONG, cells=_rows_of(cell_idx=_LONG, text=_TEXT)))


def _listed(found: list, kind: T.StructType) -> pa.Array:
    """One list of structs for each of a batch's members, from lists of tuples."""
    ends = np.cumsum([0] + [len(rows) for rows in found], dtype=np.int32)
    columns = list(zip(*(row for rows in found for row in rows))) or [[] for _ in kind]
    fields = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, kind)]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, kind.names))


def _after_table(content: str, start: int) -> int:
    """Where the table ends whose opening tag ends at ``start``. Only table tags are looked at."""
    depth, at = 1, start
    while depth > 0:
        tag = X.TABLE.search(content, at)
        if not tag:
            return len(content)
        at = tag.end()
        if tag[0][1] != "!":
            depth += X.named(tag[0])[1]
    return at


def _pieces(content: str, stored: list) -> list:
    """The tokens of a body's paragraphs that say something, in one pass that counts open elements."""
    n = dict.fromkeys(("body", "omath", "t", "p", "ppr", "r", "rpr"), 0)
    para, run, seen, out, at = -1, 0, None, [], 0
    while at < len(content):
        for found in X.pieces(content, at):
            tok, at = found[0], found.end()
            text = X.is_text(tok)
            name, step, opens = ("", 0, False) if text else X.named(tok)
            if name == "tbl" and step > 0:
                at = _after_table(content, at)
                break
            if name in n and (n["body"] > 0 or name in ("body", "omath", "t")):
                n[name] += step
            if n["body"] <= 0:
                continue
            shown = name == "blip" and opens and X.BLIP.match(tok) and X.attribute_of(tok, "embed") in stored
            if (name == "p" and opens) or shown or (name == "omath" and not opens and n["omath"] == 0):
                para, run = para + 1, 0
            if n["p"] <= 0 or n["omath"] != 0:
                continue
            in_run = n["r"] > 0
            if name == "r" and opens and in_run:
                run += 1
            if (n["t"] > 0 if text else opens and name in X.SAYING) or (in_run and seen != (para, run)):
                seen = (para, run) if in_run else seen
                out.append((found.start(), tok, para, run, n["ppr"] > 0, in_run, n["rpr"] > 0, n["t"] > 0))
    return out


def _paragraphs(content: str, stored: list) -> list:
    """The paragraphs of a body that say something, in the form of PARAGRAPHS."""
    out = []
    for idx, pieces in groupby(_pieces(content, stored), itemgetter(2)):
        style, levels, numbered, said, runs = None, [], False, False, []
        for _, tok, _, run, in_ppr, in_run, in_rpr, in_text in pieces:
            if in_run and (not runs or runs[-1][0] != run):
                runs.append((run, [], []))
            text, name = None, "" if X.is_text(tok) else X.named(tok)[0]
            if in_text:
                text = None if name else X.text_in(tok)
            elif name == "br" or name == "tab" and not in_ppr:
                text = "\n" if name == "br" else "\t"
            if text is not None:
                said = True
                if in_run:
                    runs[-1][1].append(text)
            elif name == "rfonts" and in_rpr and in_run:
                runs[-1][2].extend(f for f in (X.attribute_of(tok, a) for a in FONTS) if f is not None)
            elif in_ppr and name in ("pstyle", "ilvl"):
                value = X.attribute_of(tok, "val")
                if name == "ilvl":
                    levels += [] if value is None else [value]
                else:
                    style = style if value is None else value
            elif in_ppr and name == "numpr":
                numbered = True
        out.append((idx, style, levels, numbered, said, [(i, "".join(texts), fonts) for i, texts, fonts in runs]))
    return out


CELL_TAGS = frozenset(("body", "tbl", "tr", "tc", "t", "tab", "br", "p"))


def _tables(content: str) -> list:
    """Tables of a body. A token belongs to the table opened last at its depth."""
    body = level = in_text = 0
    count, at, held = -1, None, None
    table, rows, cells, depth, texts = {}, {}, {}, {}, {}
    for said, tok in X.cell_pieces(content):
        if not tok:
            held = None
            if said and body > 0 and level > 0:
                at = table.get(level)
                row = (at, rows.get(at, -1))
                cells[row] = cells.get(row, -1) + 1
                if depth.get(at, 0) >= 0:
                    own = texts.setdefault((*row, cells[row]), [])
                    own += [" ", X.decoded(said)] if in_text >= 0 else [" "]
                    held = own if depth.get(at, 0) > 0 else None
            continue
        if tok[0] != "<" or tok.startswith("<![CDATA["):
            if held is not None and in_text > 0:
                held.append(X.text_in(tok))
            continue
        name, step, opens = X.named(tok)
        if name not in CELL_TAGS:
            continue
        if name == "t":
            in_text += step
            continue
        if name == "tab" or name == "br" or name == "p":
            if opens and held is not None:
                held.append(" ")
            continue
        if name == "body":
            body += step
        elif name == "tbl":
            level += step
            if step > 0 and body > 0:
                count += 1
                table[level] = count
        held = None
        if body <= 0 or level <= 0:
            continue
        at = table.get(level)
        if name == "tr" and opens:
            rows[at] = rows.get(at, -1) + 1
        row = (at, rows.get(at, -1))
        if name == "tc":
            depth[at] = depth.get(at, 0) + step
            if opens:
                cells[row] = cells.get(row, -1) + 1
        cell = (*row, cells.get(row, -1))
        if depth.get(at, 0) > 0:
            held = texts.setdefault(cell, [])
        elif name == "tc" and step == 0:
            texts.setdefault(cell, [])
    found: dict = {}
    for (table_idx, row_idx, cell_idx), parts in texts.items():
        found.setdefault(table_idx, {}).setdefault(row_idx, []).append((cell_idx, "".join(parts)))
    return [(i, sorted((j, sorted(row)) for j, row in held.items())) for i, held in found.items()]


@F.arrow_udf(T.ArrayType(PIECE))
def _body_pieces(content: pa.Array, stored: pa.Array) -> pa.Array:
    return _listed([_pieces(c or "", s or []) for c, s in zip(content.to_pylist(), stored.to_pylist())], PIECE)


@F.arrow_udf(PARAGRAPHS)
def _body_paragraphs(content: pa.Array, stored: pa.Array) -> pa.Array:
    return pa.array([_paragraphs(c or "", s or []) for c, s in zip(content.to_pylist(), stored.to_pylist())], to_arrow_type(PARAGRAPHS))


@F.arrow_udf(TABLES)
def _body_tables(content: pa.Array) -> pa.Array:
    return pa.array([_tables(c or "") for c in content.to_pylist()], to_arrow_type(TABLES))


def _bodies(members: DataFrame) -> DataFrame:
    """doc_id, content and stored, the relation ids of stored files, of every body."""
    stored = relations(members).select(
        "doc_id", "rel_id", F.regexp_replace("target", r"^\./", "").alias("path")
    ).join(media(members), ["doc_id", "path"], "left_semi").groupBy("doc_id").agg(F.collect_set("rel_id").alias("stored"))
    return _member(members, BODY).join(stored, "doc_id", "left")


def _parts(members: DataFrame) -> DataFrame:
    """Tokens of body paragraphs outside tables and formulas, one row for each that says something."""
    toks = _bodies(members).select("doc_id", F.inline(_body_pieces("content", "stored")))
    return toks.withColumns({"name": X.local_name(F.col("tok")), "closes": F.lit(False)})


def paragraphs(members: DataFrame) -> DataFrame:
    """doc_id, para_idx, style_id, style_name, num_level, said and runs of the body paragraphs outside
    tables and formulas. Runs are an array of run_idx, text and fonts; ``said`` tells whether the
    paragraph has text, a number or a style.

    A paragraph is cut where an image with a stored file or a formula stands; what follows has no
    style of its own. Formulas leave the text. The body and the styles of a document meet where both
    were placed, so no paragraph moves for its style.
    """
    names = styles(members).groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("style_id", "style_name"))).alias("names"))
    found = _bodies(members).join(names, "doc_id", "left").select(
        "doc_id", "names", F.inline(_body_paragraphs("content", "stored")))
    level = F.try_element_at(F.filter(F.transform("levels", lambda v: v.try_cast("int")), lambda v: v.isNotNull()), F.lit(-1))

    def fonts(run: Column) -> Column:
        plain = F.transform(run["fonts"], lambda f: F.regexp_replace(f, r"""^[\s"']+|[\s"']+$""", ""))
        return F.array_sort(F.array_distinct(F.filter(plain, lambda f: f != "")))

    return found.select(
        "doc_id", "para_idx", "style_id", F.try_element_at("names", F.col("style_id")).alias("style_name"),
        F.when(F.col("numbered"), F.coalesce(level, F.lit(0))).alias("num_level"),
        (F.col("said") | F.col("numbered") | F.col("style_id").isNotNull()).alias("said"),
        F.transform("runs", lambda r: F.struct(
            r["run_idx"].alias("run_idx"), r["text"].alias("text"), fonts(r).alias("fonts"))).alias("runs"))


def read_body(members: DataFrame) -> dict[str, DataFrame]:
    """Rows of the body: paras, runs, refs, uses and cells, as the operators of ``office`` take them.

    See ``paragraphs``. A table in a cell is a table of its own, numbered after the one around it, and
    its text is not in that cell. What is open at a token is counted in one pass over its member, so
    that tokens which say nothing never become rows.
    """
    found = paragraphs(members)
    embed = X.attribute(F.col("tok"), "embed")
    uses = _parts(members).where(_opens("blip")).select("doc_id", "para_idx", embed.alias("rel_id")).where("rel_id IS NOT NULL")
    in_body = _tags(members, BODY, "body", "footnotereference").select("*", _depth("body", _ordered("doc_id")).alias("in_body"))
    refs = in_body.where((F.col("in_body") > 0) & _opens("footnotereference")).select(
        "doc_id", X.attribute(F.col("tok"), "id").alias("note_id")).where("note_id IS NOT NULL")
    return {"paras": found.where("said").select("doc_id", "para_idx", "style_id", "num_level"),
            "runs": found.select("doc_id", "para_idx", F.inline("runs")), "uses": uses, "refs": refs, "cells": _cells(members)}


def _cells(members: DataFrame) -> DataFrame:
    """doc_id, table_idx, row_idx, cell_idx, text of every cell."""
    return tables(members).select("doc_id", "table_idx", F.inline("rows")).select(
        "doc_id", "table_idx", "row_idx", F.inline("cells"))


def tables(members: DataFrame) -> DataFrame:
    """doc_id, table_idx and rows of every table: an array of row_idx and cells, an array of cell_idx
    and text. Paragraphs of a cell are joined by a space."""
    plain = lambda c: F.struct(c["cell_idx"].alias("cell_idx"), H.collapse(c["text"]).alias("text"))
    return _member(members, BODY).select("doc_id", F.inline(_body_tables("content"))).select(
        "doc_id", "table_idx", F.transform("rows", lambda r: F.struct(
            r["row_idx"].alias("row_idx"), F.transform(r["cells"], plain).alias("cells"))).alias("rows"))


def read_documents(members: DataFrame) -> dict[str, DataFrame]:
    """All row tables of a set of documents, ready for the operators of ``office``."""
    return {**read_body(members), "styles": styles(members), "notes": notes(members),
            "rels": relations(members), "media": media(members)}
