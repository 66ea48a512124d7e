"""Schedules, pause plans and reading load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textpace.functions import pacing as P
from textpace.functions import words as W
from textpace.operators.ordered import by_key
from textpace.operators.tokens import chunks


def beats(docs: DataFrame, wpm: int = P.DEFAULT_WPM, size: int = 1, key: str = "doc_id") -> DataFrame:
    """One row per beat: chunk_id, words, delay in seconds. No shuffle."""
    slowest = F.array_max(F.transform("words", lambda w: P.word_delay(w, wpm)))
    return chunks(docs, size, key).select(
        key, "chunk_id", "words", P.chunk_delay(slowest, F.size("words")).alias("delay")
    )


def schedule(docs: DataFrame, wpm: int = P.DEFAULT_WPM, size: int = 1, key: str = "doc_id") -> DataFrame:
    """Start and end second of every beat."""
    rows = beats(by_key(docs.select(key, "text"), key), wpm, size, key)
    upto = Window.partitionBy(key).orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("delay").over(upto)
    return rows.select(
        key, "chunk_id", "words", "delay", (end - F.col("delay")).alias("start_s"),
        end.alias("end_s"),
    )


def chunk_pivots(docs: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """Each chunk split at the pivot of its first word, the other words trailing."""
    parts = P.with_pivot(chunks(docs, size, key).withColumn("word", F.col("words")[0]))
    cut = P.split_at_pivot(F.col("word"), F.col("pivot"))
    return parts.select(
        key, "chunk_id", "pivot", cut["before"].alias("before"),
        cut["pivot_char"].alias("pivot_char"), cut["after"].alias("after"),
        F.when(F.size("words") > 1,
               F.concat(F.lit(" "), F.array_join(F.slice("words", 2, 7), " ")))
        .otherwise("").alias("trailing"),
    )


def pause_plan(docs: DataFrame, wpm: int = P.DEFAULT_WPM, size: int = 1, pause: float = P.DEFAULT_PAUSE,
               enabled: dict[str, bool] | None = None, key: str = "doc_id",
               stops: Column | None = None) -> DataFrame:
    """Beats of a document whose placeholder words stop the stream.

    ``stops`` is an ARRAY<INT> column with the word positions of placeholder blocks; by default
    every placeholder word counts. Only a placeholder that starts a beat stops; the beat after
    a stop lasts a fixed 0.6 s and later beats align to it. A last-word placeholder ends the plan.
    """
    n = max(1, min(7, size))
    on = [k for k, v in {**P.AUTO_PAUSE, **(enabled or {})}.items() if v]
    hold = max(P.PAUSE_RANGE[0], min(P.PAUSE_RANGE[1], pause))
    tokens = docs.select(key, W.words(F.col("text")).alias("words"),
                         *([stops.alias("given")] if stops is not None else []))
    marks = F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(on), i)) if stops is None
        else F.col("given"),
        lambda i: i.isNotNull(),
    )
    state = "struct<start:int,runs:array<struct<start:int,stop:int>>>"
    # A stop closes the current run of beats; the next run starts on the word after it.
    runs = F.aggregate(
        F.col("marks"),
        F.expr(f"cast(named_struct('start', 0, 'runs', array()) as {state})"),
        lambda s, q: F.when(
            (q >= s["start"]) & ((q - s["start"]) % n == 0),
            F.struct(
                (q + 1).alias("start"),
                F.concat(s["runs"], F.array(F.struct(s["start"].alias("start"), q.alias("stop"))))
                .alias("runs"),
            ),
        ).otherwise(s),
        lambda s: F.concat(
            s["runs"],
            F.array(F.struct(s["start"].alias("start"), F.size("words").alias("stop"))),
        ),
    )
    per_run = (
        tokens.withColumn("marks", marks).where(F.size("words") > 0)
        .select(key, "words", F.posexplode(runs).alias("run", "r"))
        .select(key, "run", "r.start", "r.stop",
                (F.col("r.stop") < F.size("words")).alias("holds"),
                F.slice("words", F.col("r.start") + 1, F.col("r.stop") - F.col("r.start") + 1)
                .alias("words"))
    )
    # Positions where a beat of this run starts: start, start + n, ... and the stop itself.
    last = F.when(F.col("holds"), F.col("stop")).otherwise(F.col("stop") - 1)
    at = F.when(F.col("start") <= last, F.sequence(F.col("start"), last, F.lit(n)))
    rows = per_run.select("*", F.explode(at).alias("word_idx"))
    piece = F.slice("words", F.col("word_idx") - F.col("start") + 1, F.lit(n))
    is_stop = F.col("holds") & (F.col("word_idx") == F.col("stop"))
    slowest = F.array_max(F.transform(piece, lambda w: P.word_delay(w, wpm)))
    return rows.select(
        key, "word_idx", is_stop.alias("is_stop"),
        F.when(is_stop, F.lit(float(hold)))
        .when((F.col("run") > 0) & (F.col("word_idx") == F.col("start")), F.lit(P.RESUME_BEAT))
        .otherwise(P.chunk_delay(slowest, F.size(piece))).alias("delay"),
    )


def reading_load(docs: DataFrame, by: list[str], wpm: int = P.DEFAULT_WPM, rollup: bool = False) -> DataFrame:
    """Documents, words, scheduled and usual seconds per group.

    Words are summed straight into the groups; partial sums are made before the shuffle, so
    a group holding most rows costs no more than a small one.
    """
    words = docs.select(*by, F.posexplode_outer(W.words(F.col("text"))).alias("word_idx", "word"))
    doc_start = F.coalesce(F.col("word_idx") == 0, F.lit(True))
    grouped = words.rollup(*by) if rollup else words.groupBy(*by)
    sums = grouped.agg(
        F.count_if(doc_start).alias("n_docs"),
        F.count("word").alias("n_words"),
        F.sum(P.delay_factor(F.col("word"))).alias("_factor"),
    )
    paced = F.coalesce(F.col("_factor"), F.lit(0.0)) * F.lit(60.0) / F.lit(float(wpm))
    usual = F.col("n_words") / F.lit(float(P.TRADITIONAL_WPM)) * 60.0
    return sums.select(
        *by, "n_docs", "n_words",
        F.round(paced, 4).alias("scheduled_s"),
        F.round(usual, 4).alias("usual_s"),
        F.round(usual - F.col("n_words") / F.lit(float(wpm)) * 60.0, 4).alias("saved_s"),
        F.round(F.col("n_words") / paced * 60.0, 4).alias("effective_wpm"),
    )
