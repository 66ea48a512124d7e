"""Search over word streams and raw text.

Queries are a short list of strings typed by a user, so they enter the plan as literals
and every match test stays inside the document row: no join and no row pairs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from textpace.functions import words as W
from textpace.operators.ordered import by_key

REGEX_SPECIAL = r"[.*+?^${}()|\[\]\\]"


def escape_regex(text: Column) -> Column:
    """Backslash before every regex metacharacter."""
    return F.regexp_replace(text, REGEX_SPECIAL, r"\\$0")


def _needles(queries: list[str]) -> list[tuple[int, str]]:
    return [(i, q.lower()) for i, q in enumerate(queries) if q]


def _literal(q: str) -> str:
    """A query as a pattern that matches only itself."""
    return re.sub(REGEX_SPECIAL, r"\\\g<0>", q)


def _query_ids(lowered: Column, queries: list[str]) -> Column:
    """ARRAY<INT> of the queries that a lower-cased string contains."""
    tests = [F.when(F.contains(lowered, F.lit(q)), F.lit(i)) for i, q in _needles(queries)]
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<int>")


def find_words(docs: DataFrame, queries: list[str], key: str = "doc_id") -> DataFrame:
    """Words that contain a query, ignoring case: key, query_id, word_idx, word."""
    tokens = docs.select(key, F.posexplode(W.words(F.col("text"))).alias("word_idx", "word"))
    return tokens.select(
        key, "word_idx", "word",
        F.explode(_query_ids(F.lower("word"), queries)).alias("query_id"),
    )


def match_totals(docs: DataFrame, queries: list[str], key: str = "doc_id") -> DataFrame:
    """Matches per document and query, zeros included. No shuffle."""
    tokens = docs.select(key, F.transform(W.words(F.col("text")), F.lower).alias("words"))
    known = dict(_needles(queries))

    def count(i: int) -> Column:
        if i not in known:
            return F.lit(0)
        return F.size(F.filter("words", lambda w: F.contains(w, F.lit(known[i]))))

    counts = [
        F.struct(F.lit(i).alias("query_id"), count(i).alias("n")) for i in range(len(queries))
    ]
    return tokens.select(key, F.explode(F.array(*counts)).alias("c")).select(key, "c.query_id", "c.n")


def neighbours(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Next and previous match of each match, wrapping around."""
    w = Window.partitionBy(key, "query_id").orderBy("word_idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return hits.select(
        key, "query_id", "word_idx",
        F.coalesce(F.lead("word_idx").over(w), F.first("word_idx").over(whole)).alias("next_idx"),
        F.coalesce(F.lag("word_idx").over(w), F.last("word_idx").over(whole)).alias("prev_idx"),
    )


def find_word_neighbours(docs: DataFrame, queries: list[str], key: str = "doc_id") -> DataFrame:
    """Matches with their neighbours; texts are placed by key before they are exploded."""
    return neighbours(find_words(by_key(docs.select(key, "text"), key), queries, key), key)


def occurrences(docs: DataFrame, queries: list[str], keys: list[str] = ["doc_id"]) -> DataFrame:
    """Non-overlapping matches in the raw text: keys, query_id, match_idx, [start, end)."""
    text = F.lower("text")
    # Pieces between matches; each match starts where the lengths so far end.
    pieces = [
        F.when(F.contains(text, F.lit(q)),
               F.struct(F.lit(i).alias("query_id"), F.lit(len(q)).alias("n"),
                        F.split(text, _literal(q)).alias("parts")))
        for i, q in _needles(queries)
    ]
    per_query = by_key(docs.select(*keys, "text"), *keys).select(
        *keys, F.explode(F.array_compact(F.array(*pieces))).alias("m")
    ).select(*keys, "m.query_id", "m.n", F.posexplode("m.parts").alias("match_idx", "part"))
    w = Window.partitionBy(*keys, "query_id").orderBy("match_idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.length("part")).over(upto) + F.col("match_idx") * F.col("n")
    last = F.lead("match_idx").over(w).isNull()
    return (
        per_query.select(*keys, "query_id", "match_idx", start.alias("start"),
                         (start + F.col("n")).alias("end"), last.alias("_last"))
        .where(~F.col("_last")).drop("_last")
    )


def occurrence_words(docs: DataFrame, queries: list[str], key: str = "doc_id") -> DataFrame:
    """Word index of each raw-text match: its first overlapping word, else the words before it.

    Both cases equal the number of words that end at or before the match start, so one ordered
    scan over word ends and match starts replaces a range join.
    """
    from textpace.operators.tokens import token_ranges

    ends = token_ranges(docs, key).select(
        key, F.col("end").cast("long").alias("pos"), F.lit(0).alias("kind"),
        F.lit(None).cast("int").alias("query_id"), F.lit(None).cast("int").alias("match_idx"))
    starts = occurrences(docs, queries, [key]).select(
        key, F.col("start").cast("long").alias("pos"), F.lit(1).alias("kind"), "query_id", "match_idx")
    seen = Window.partitionBy(key).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ends.unionByName(starts)
        .select("*", F.sum(1 - F.col("kind")).over(seen).alias("word_idx"))
        .where(F.col("kind") == 1)
        .select(key, "query_id", "match_idx", F.col("pos").alias("start"), "word_idx")
    )


def concordance(docs: DataFrame, queries: list[str], before: int = 5, after: int = 60,
                key: str = "doc_id") -> DataFrame:
    """Matches with the words around them, cut from the document's own word array."""
    tokens = docs.select(key, W.words(F.col("text")).alias("words"))
    ids = tokens.select(
        key, "words",
        F.filter(
            F.transform("words", lambda w, i: F.struct(
                i.alias("word_idx"), _query_ids(F.lower(w), queries).alias("ids"))),
            lambda h: F.size(h["ids"]) > 0,
        ).alias("hits"),
    )
    rows = F.transform("hits", lambda h: F.struct(
        h["word_idx"].alias("word_idx"), h["ids"].alias("ids"),
        W.word_at(F.col("words"), h["word_idx"]).alias("word"),
        F.array_join(W.previous(F.col("words"), h["word_idx"], before), " ").alias("previous_words"),
        F.array_join(W.upcoming(F.col("words"), h["word_idx"], after), " ").alias("upcoming_words"),
    ))
    return ids.select(key, F.explode(rows).alias("r")).select(
        key, F.explode("r.ids").alias("query_id"), "r.word_idx", "r.word",
        "r.previous_words", "r.upcoming_words",
    )


def hit_states(docs: DataFrame, text: str, active: int = 0, key: str = "doc_id") -> DataFrame:
    """State of every word for one query: none, hit, or active for match number ``active``."""
    q = text.lower()
    flags = F.transform(W.words(F.col("text")), lambda w: F.contains(F.lower(w), F.lit(q)) if q else F.lit(False))
    hits = F.filter(F.transform("flags", lambda hit, i: F.when(hit, i)), lambda i: i.isNotNull())
    # A plain column to explode would become a filter on its size, which finds all words once more.
    exploded = F.posexplode(F.coalesce("flags", F.array().cast("array<boolean>")))
    return docs.select(key, flags.alias("flags")).select(
        key, "flags", F.try_element_at(hits, F.lit(active + 1)).alias("at")).select(
        key, "at", exploded.alias("word_idx", "hit")).select(
        key, "word_idx", F.when(F.col("word_idx") == F.col("at"), "active").when(F.col("hit"), "hit").otherwise("none").alias("state"))
