"""Typed blocks, outlines and lookups.

Block tables carry key, block_idx, type, text and, for some types, level and payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textpace.functions import words as W
from textpace.operators.ordered import running, span_bucket


def split_blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Paragraph blocks of plain text: pieces between blank lines, trimmed, empties dropped."""
    parts = F.filter(
        F.transform(F.split("text", "\n\n"), lambda p: W.trim_space(p)), lambda p: p != ""
    )
    return docs.select(key, F.posexplode(parts).alias("block_idx", "text")).withColumn(
        "type", F.lit("paragraph")
    )


def plain_text(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks joined by blank lines, in order. The result is one text value per document."""
    ordered = F.sort_array(F.collect_list(F.struct("block_idx", "text")))
    return blocks.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda b: b["text"]), "\n\n").alias("plain_text")
    )


def word_offsets(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add n_words and the index of the first word of each block in the document stream."""
    counted = blocks.withColumn("n_words", W.word_count(F.col("text")))
    return running(counted, [key], ["block_idx"], span_bucket("block_idx"),
                   sums={"word_offset": F.col("n_words")})


def pauseable(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Word index of every image, formula, table or code block with a usable payload."""
    body = W.trim_space(F.coalesce("payload", F.lit("")))
    kinds = ("image", "formula", "table", "code")
    return (
        word_offsets(blocks, key)
        .where(F.col("type").isin(*kinds) & (body != ""))
        .select(
            key, F.col("word_offset").alias("word_idx"), "block_idx",
            F.col("type").alias("kind"),
            F.when(F.col("type") == "code", F.col("payload")).otherwise(body).alias("payload"),
        )
    )


def heading_items(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Flat outline items from heading blocks, numbered in order."""
    head = F.col("type") == "heading"
    counted = blocks.select(
        key, "block_idx", "type", "level", F.when(head, F.col("text")).alias("title"),
        W.word_count(F.col("text")).alias("n_words"))
    return running(
        counted, [key], ["block_idx"], span_bucket("block_idx"),
        sums={"word_idx": F.col("n_words"), "toc_idx": F.when(head, 1).otherwise(0)},
    ).where(head).select(key, F.col("toc_idx").cast("int"), "block_idx", "level", "title", "word_idx")


def nest(items: DataFrame, key: str = "doc_id", max_level: int | None = 6) -> DataFrame:
    """Add parent_idx and depth to flat outline items (key, toc_idx, level).

    The parent is the nearest earlier item with a lower level. Heading levels end at 6; for
    outlines without such a bound pass ``max_level=None`` and the deepest level is read first.
    Items with a level below 1 have no place in an outline and are dropped.
    """
    rows = items.where(F.col("level") >= 1)
    if max_level is None:
        max_level = rows.agg(F.max("level")).first()[0] or 1
    levels = range(1, max_level)
    seen = running(
        rows, [key], ["toc_idx"], span_bucket("toc_idx"),
        lasts={f"_l{k}": F.when(F.col("level") == k, F.col("toc_idx")) for k in levels},
    ) if max_level > 1 else rows
    below = F.array(*[
        F.when(F.col("level") > k, F.col(f"_l{k}")).cast("int") for k in levels
    ]) if max_level > 1 else F.array().cast("array<int>")
    # An ancestor chain holds, per level, the last item that is later than all shallower ones.
    depth = F.aggregate(
        below, F.struct(F.lit(-1).alias("top"), F.lit(1).alias("depth")),
        lambda s, i: F.struct(
            F.greatest(s["top"], i).alias("top"),
            (s["depth"] + F.when(i > s["top"], 1).otherwise(0)).alias("depth"),
        ),
        lambda s: s["depth"],
    )
    return seen.select(
        *[F.col(c) for c in items.columns], F.array_max(below).alias("parent_idx"),
        depth.alias("depth"),
    )


def outline(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Nested outline of a document's headings; toc_idx is its depth-first order."""
    return nest(heading_items(blocks, key), key)


def suppress_short(toc: DataFrame, key: str = "doc_id") -> DataFrame:
    """Outlines with at least two top-level entries; shorter ones vanish whole."""
    enough = (
        toc.where(F.col("parent_idx").isNull()).groupBy(key).agg(F.count("*").alias("roots"))
        .where(F.col("roots") > 1).select(key)
    )
    return toc.join(enough, key, "left_semi")


def active_section(positions: DataFrame, toc: DataFrame, key: str = "doc_id") -> DataFrame:
    """Last outline entry at or before each position (an as-of lookup); null before the first.

    Equal positions are looked up once; entries and positions share one ordered scan.
    """
    wanted = positions.select(key, F.col("word_idx").cast("long")).distinct()
    events = toc.select(
        key, F.col("word_idx").cast("long").alias("word_idx"), F.lit(0).alias("_kind"), "toc_idx"
    ).unionByName(
        wanted.select(key, "word_idx", F.lit(1).alias("_kind"), F.lit(0).alias("toc_idx"))
    )
    found = running(
        events, [key], ["word_idx", "_kind", "toc_idx"], span_bucket("word_idx"),
        lasts={"active_idx": F.when(F.col("_kind") == 0, F.col("toc_idx"))},
    ).where(F.col("_kind") == 1).select(key, "word_idx", "active_idx")
    return positions.join(found, [key, "word_idx"])


def filter_titles(toc: DataFrame, text: str) -> DataFrame:
    """Entries whose title contains the text, ignoring case; all entries for a blank text."""
    needle = text.strip().lower()
    return toc.where(F.lower("title").contains(needle)) if needle else toc


def heading_pages(toc: DataFrame, blocks: DataFrame, key: str = "doc_id", group: int = 512) -> DataFrame:
    """Page of each outline entry.

    By block index where the entry has one with a page; else the first block whose normalised
    text contains the title, else the first that contains its first three words. Titles of a
    document reach its blocks as small arrays (at most ``group`` titles each) and only matches
    leave a block, reduced to the earliest before any shuffle.
    """
    title = W.trim_space(F.col("title"))
    first_words = F.array_join(
        F.slice(F.filter(F.split(title, " "), lambda p: p != ""), 1, 3), " "
    )
    wanted = toc.select(
        key, "toc_idx", W.normalize_match(title).alias("full"),
        F.when(first_words != title, W.normalize_match(first_words)).alias("short"),
    ).where(F.col("full") != "")
    needles = wanted.groupBy(key, F.floor(F.col("toc_idx") / group).alias("_g")).agg(
        F.collect_list(F.struct("toc_idx", "full", "short")).alias("needles")
    )
    body = blocks.select(key, "block_idx", "page", W.normalize_match(F.col("text")).alias("norm"))
    hits = body.join(needles, key).select(
        key, "block_idx", "page",
        F.explode(F.filter(
            F.transform("needles", lambda n: F.struct(
                n["toc_idx"].alias("toc_idx"),
                F.when(F.contains(F.col("norm"), n["full"]), 0)
                .when((n["short"] != "") & F.contains(F.col("norm"), n["short"]), 1).alias("rank"),
            )),
            lambda h: h["rank"].isNotNull(),
        )).alias("h"),
    )
    by_text = hits.groupBy(key, F.col("h.toc_idx").alias("toc_idx")).agg(
        F.min(F.struct(F.col("h.rank").alias("rank"), "block_idx", "page")).alias("m")
    ).select(key, "toc_idx", F.col("m.page").alias("text_page"))
    direct = blocks.select(key, "block_idx", F.col("page").alias("block_page"))
    return (
        toc.join(direct, [key, "block_idx"], "left").join(by_text, [key, "toc_idx"], "left")
        .select(key, "toc_idx", F.coalesce("block_page", "text_page").alias("page"))
    )


def type_profile(blocks: DataFrame, kinds: list[str], key: str = "doc_id") -> DataFrame:
    """Block counts per type and the word share of prose, per document."""
    n = W.word_count(F.col("text"))
    prose = F.col("type").isin("paragraph", "heading", "list", "quote")
    return (
        blocks.select(key, "type", n.alias("n_words"), prose.alias("prose"))
        .groupBy(key)
        .agg(
            F.count("*").alias("n_blocks"),
            *[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in kinds],
            F.sum("n_words").alias("n_words"),
            F.round(
                F.sum(F.when(F.col("prose"), F.col("n_words")).otherwise(0)) / F.sum("n_words"), 6
            ).alias("prose_share"),
        )
    )


def prepend_title(blocks: DataFrame, titles: DataFrame, key: str = "doc_id") -> DataFrame:
    """A level-1 heading block with the document title first; documents without one are kept as is."""
    named = titles.where(F.coalesce(F.col("title"), F.lit("")) != "")
    shifted = blocks.join(named.select(key, F.lit(1).alias("_shift")), key, "left").select(
        key, (F.col("block_idx") + F.coalesce("_shift", F.lit(0))).alias("block_idx"),
        "type", "level", "text",
    )
    heads = named.join(blocks.select(key).distinct(), key, "left_semi").select(
        key, F.lit(0).cast("long").alias("block_idx"), F.lit("heading").alias("type"),
        F.lit(1).alias("level"), F.col("title").alias("text"),
    )
    return shifted.unionByName(heads)
