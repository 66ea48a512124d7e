"""Word streams: tokens, ranges, lines, chunks and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from textpace.functions import words as W
from textpace.operators.ordered import by_key, running, span_bucket

MARK = "\u0001"


def tokenize(docs: DataFrame, key: str = "doc_id", curly_quotes: bool = False) -> DataFrame:
    """One row per word: key, word_idx, word. No shuffle."""
    return docs.select(
        key, F.posexplode(W.words(F.col("text"), curly_quotes)).alias("word_idx", "word")
    )


def token_ranges(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Words with their [start, end) character range in the text."""
    pieces = by_key(docs.select(key, "text"), key).select(
        key,
        F.posexplode(
            F.split(F.regexp_replace("text", W.WORD_PATTERN, f"{MARK}$0{MARK}"), MARK)
        ).alias("pos", "piece"),
    )
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = pieces.select(
        key, "pos", "piece", F.sum(F.length("piece")).over(before).cast("int").alias("end")
    )
    return ends.where(F.col("pos") % 2 == 1).select(
        key,
        F.floor(F.col("pos") / 2).cast("int").alias("word_idx"),
        F.col("piece").alias("word"),
        (F.col("end") - F.length("piece")).alias("start"),
        "end",
    )


def word_counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(
        key,
        W.word_count(F.col("text")).alias("n_words"),
        W.display_word_count(F.col("text")).alias("n_display_words"),
    )


def vocabulary(docs: DataFrame) -> DataFrame:
    """Distinct words with counts; partial counts are made before the shuffle."""
    return (
        docs.select(F.explode(W.words(F.col("text"))).alias("word"))
        .groupBy("word").agg(F.count("*").alias("n"))
    )


def paragraphs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with words or blank spacer lines, in order, with global word indices.

    Lines that are neither blank nor contain a word vanish.
    """
    lines = by_key(docs.select(key, "text"), key).select(
        key, F.posexplode(F.split("text", "\n")).alias("line_idx", "line")
    )
    parsed = lines.select(
        key, "line_idx", W.is_blank(F.col("line")).alias("is_spacer"),
        W.words(F.col("line")).alias("words"),
    ).where(F.col("is_spacer") | (F.size("words") > 0))
    w = Window.partitionBy(key).orderBy("line_idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return parsed.select(
        key,
        (F.row_number().over(w) - 1).alias("para_idx"),
        "is_spacer",
        F.size("words").alias("n_words"),
        (F.sum(F.size("words")).over(upto) - F.size("words")).cast("int").alias("first_idx"),
        "words",
    )


def block_paragraphs(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same for typed blocks: a spacer follows each block, except a final one.

    Input: key, block_idx, type, text. Long block lists are scanned in spans.
    """
    lines = blocks.select(
        key, "block_idx", "type",
        F.posexplode(F.concat(F.split("text", "\n"), F.array(F.lit(None).cast("string"))))
        .alias("line_idx", "line"),
    )
    parsed = lines.select(
        key, "block_idx", "line_idx",
        F.when(F.col("line").isNull(), "paragraph").otherwise(F.col("type")).alias("type"),
        F.coalesce(W.is_blank(F.col("line")), F.lit(True)).alias("is_spacer"),
        F.col("line").isNull().alias("is_end"),
        F.coalesce(W.words(F.col("line")), F.array().cast("array<string>")).alias("words"),
    ).where(F.col("is_spacer") | (F.size("words") > 0))
    final = parsed.groupBy(key).agg(F.max("block_idx").alias("_last"))
    kept = parsed.join(final, key).where(
        ~(F.col("is_end") & (F.col("block_idx") == F.col("_last")))
    )
    out = running(
        kept, [key], ["block_idx", "line_idx"], span_bucket("block_idx", 512),
        sums={"first_idx": F.size("words"), "para_idx": F.lit(1)},
    )
    return out.select(
        key, F.col("para_idx").cast("int"), "block_idx", "type", "is_spacer",
        F.size("words").alias("n_words"), F.col("first_idx").cast("int"), "words",
    )


def locate_paragraphs(positions: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """First word of the paragraph that holds each position's word; null when none does.

    The paragraph bounds of a document stay one small array on its row, so the join is
    one row per document and positions never meet all paragraphs as row pairs.
    """
    counts = F.transform(F.split("text", "\n"), lambda l: F.size(W.words(l)))
    bounds = docs.select(key, counts.alias("counts"))
    wanted = positions.select(key, "word_idx").distinct()
    state = "struct<seen:int,first:int>"
    found = wanted.join(bounds, key).select(
        key, "word_idx",
        F.aggregate(
            "counts",
            F.expr("named_struct('seen', 0, 'first', cast(null as int))").cast(state),
            lambda s, n: F.struct(
                (s["seen"] + n).alias("seen"),
                F.when(
                    (F.col("word_idx") >= s["seen"]) & (F.col("word_idx") < s["seen"] + n),
                    s["seen"],
                ).otherwise(s["first"]).alias("first"),
            ),
            lambda s: s["first"],
        ).alias("paragraph_first"),
    )
    return positions.join(found, [key, "word_idx"])


def chunks(docs: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """Words N at a time; the last chunk may be short. N is clamped to 1..7."""
    n = max(1, min(7, size))
    tokens = docs.select(key, W.words(F.col("text")).alias("words"))
    grouped = F.when(
        F.size("words") > 0,
        F.transform(
            F.sequence(F.lit(0), F.size("words") - 1, F.lit(n)),
            lambda i: F.slice("words", i + 1, F.lit(n)),
        ),
    )
    return tokens.select(key, F.posexplode(grouped).alias("chunk_id", "words"))


def context_at(positions: DataFrame, docs: DataFrame, key: str = "doc_id",
               before: int = 5, after: int = 60) -> DataFrame:
    """Word, previous words and upcoming words at given positions."""
    tokens = docs.select(key, W.words(F.col("text")).alias("words"))
    at = F.col("word_idx")
    return positions.join(tokens, key).select(
        *[F.col(c) for c in positions.columns],
        W.word_at(F.col("words"), at).alias("word"),
        F.array_join(W.previous(F.col("words"), at, before), " ").alias("previous_words"),
        F.array_join(W.upcoming(F.col("words"), at, after), " ").alias("upcoming_words"),
    )


def previous_context(docs: DataFrame, limit: int = 5, key: str = "doc_id") -> DataFrame:
    """Each word with the words before it, built inside the document row."""
    tokens = docs.select(key, W.words(F.col("text")).alias("words"))
    rows = F.transform(
        "words",
        lambda w, i: F.struct(
            w.alias("word"),
            F.array_join(W.previous(F.col("words"), i, limit), " ").alias("previous_words"),
        ),
    )
    return tokens.select(key, F.posexplode(rows).alias("word_idx", "r")).select(
        key, "word_idx", "r.word", "r.previous_words"
    )
