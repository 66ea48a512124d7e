"""Reading-session analytics per user. "Now" is always an explicit as_of date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from textpace.functions import pacing as P
from textpace.functions import words as W
from textpace.operators.ordered import scan, with_time_span

# --- fixed values ---
MIN_SECONDS, MIN_WORDS = 5, 10
HISTORY = 200
RECENTS = 10
ACTIVE_MINUTES = 0.1
BUCKETS = (0.1, 15, 30, 60)
# --- end of fixed values ---


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def valid(sessions: DataFrame) -> DataFrame:
    return sessions.where(
        (F.col("reading_time_seconds") >= MIN_SECONDS) & (F.col("total_words") >= MIN_WORDS))


def with_metrics(sessions: DataFrame) -> DataFrame:
    """Add actual_wpm (at most the setting), usual_seconds and saved_seconds."""
    t, n = F.col("reading_time_seconds"), F.col("total_words")
    actual = F.when(t > 0, F.least(F.col("configured_wpm"), (n / (t / 60.0)).cast("int"))).otherwise(
        F.col("configured_wpm"))
    usual = n / F.lit(float(P.TRADITIONAL_WPM)) * 60.0
    return sessions.select("*", actual.alias("actual_wpm"), usual.alias("usual_seconds"),
                           (usual - t).alias("saved_seconds"))


def history(sessions: DataFrame, keep: int = HISTORY) -> DataFrame:
    """Newest valid sessions per user. The rank limit is applied before the shuffle as well."""
    w = Window.partitionBy("user_id").orderBy(F.desc("finished_at"), F.desc("event_id"))
    return valid(sessions).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def totals(sessions: DataFrame) -> DataFrame:
    """Sessions, words, saved seconds (losses count as 0) and time-weighted words per minute."""
    t = F.col("reading_time_seconds")
    return with_metrics(sessions).groupBy("user_id").agg(
        F.count("*").alias("n_sessions"), F.sum("total_words").alias("n_words"),
        F.round(F.sum(F.greatest(F.lit(0.0), F.col("saved_seconds"))), 4).alias("saved_seconds"),
        F.when(F.sum(t) > 0, F.floor(F.sum(F.col("actual_wpm") * t) / F.sum(t) + 1e-9)).otherwise(0)
        .cast("int").alias("average_wpm"),
    )


def daily(sessions: DataFrame) -> DataFrame:
    """Minutes and session counts per user and day; short sessions count too."""
    return sessions.where("reading_time_seconds > 0").groupBy(
        "user_id", day_of(F.col("finished_at")).alias("day")
    ).agg(F.sum(F.col("reading_time_seconds") / 60.0).alias("minutes"), F.count("*").alias("sessions"))


def active(days: DataFrame) -> DataFrame:
    return days.where(F.col("minutes") >= ACTIVE_MINUTES)


def _islands(days: DataFrame) -> DataFrame:
    """Runs of consecutive active days. A user has at most one row per calendar day here."""
    w = Window.partitionBy("user_id").orderBy("day")
    return (
        active(days)
        .withColumn("_run", F.date_sub("day", F.row_number().over(w)))
        .groupBy("user_id", "_run").agg(F.count("*").alias("length"), F.max("day").alias("last_day"))
    )


def streaks(days: DataFrame, as_of: dt.date) -> DataFrame:
    """Current streak (ending on as_of or the day before) and longest streak, zeros included."""
    # Days after as_of are not yet known on that date, so they cannot end or extend the current run.
    known = F.col("day") <= F.lit(as_of)
    w = Window.partitionBy("user_id").orderBy("day")
    lively = F.col("minutes") >= ACTIVE_MINUTES
    place = F.sum(lively.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # Idle days are a run of their own, so that users without an active day stay.
    runs = days.withColumn("_run", F.when(lively, F.date_sub("day", place.cast("int")))).groupBy("user_id", "_run").agg(
        F.count_if(lively).alias("length"), F.count_if(lively & known).alias("known"),
        F.max(F.when(lively & known, F.col("day"))).alias("last_day"))
    alive = F.col("last_day").isin(as_of, as_of - dt.timedelta(days=1))
    return runs.groupBy("user_id").agg(
        F.coalesce(F.max(F.when(alive, F.col("known"))), F.lit(0)).alias("current_streak"),
        F.max("length").alias("longest_streak"))


def activity_totals(days: DataFrame) -> DataFrame:
    return days.groupBy("user_id").agg(
        F.count_if(F.col("minutes") >= ACTIVE_MINUTES).alias("active_days"),
        F.round(F.sum("minutes"), 4).alias("minutes"))


def calendar(days: DataFrame, as_of: dt.date, n: int) -> DataFrame:
    """The last n days per user, oldest first, zeros where nothing was read."""
    span = F.sequence(F.lit(as_of - dt.timedelta(days=n - 1)), F.lit(as_of))
    grid = days.select("user_id").distinct().select("user_id", F.posexplode(span).alias("idx", "day"))
    recent = days.where((F.col("day") > F.lit(as_of - dt.timedelta(days=n))) & (F.col("day") <= F.lit(as_of)))
    return grid.join(recent, ["user_id", "day"], "left").select(
        "user_id", "idx", "day", F.coalesce("minutes", F.lit(0.0)).alias("minutes"),
        F.coalesce("sessions", F.lit(0)).alias("sessions"))


def activity_bucket(minutes: Column) -> Column:
    out = F.when(minutes < BUCKETS[0], 0)
    for i, top in enumerate(BUCKETS[1:], 1):
        out = out.when(minutes < top, i)
    return out.otherwise(len(BUCKETS))


def heatmap(days: DataFrame, as_of: dt.date, weeks: int) -> DataFrame:
    """Calendar cells with week, weekday row, colour bucket and a label where the month changes."""
    w = Window.partitionBy("user_id").orderBy("idx")
    cells = calendar(days, as_of, weeks * 7)
    change = F.coalesce(F.lag(F.month("day")).over(w) != F.month("day"), F.lit(True))
    return cells.select(
        "user_id", "idx", F.floor(F.col("idx") / 7).cast("int").alias("week"), (F.col("idx") % 7).alias("row"),
        "day", activity_bucket(F.col("minutes")).alias("bucket"),
        F.when(change, F.date_format("day", "MMM")).alias("month_label"))


def latest_positions(positions: DataFrame) -> DataFrame:
    """Last saved position per user and document."""
    at = F.struct("ts", "event_id")
    return positions.groupBy("user_id", "doc_id").agg(
        F.max_by("word_idx", at).alias("word_idx"), F.max("ts").alias("ts"))


def resumable(latest: DataFrame, docs: DataFrame) -> DataFrame:
    """Positions that can be resumed, with percent read (at most 100)."""
    counts = docs.select("doc_id", W.display_word_count(F.col("text")).alias("n_words"))
    i, n = F.col("word_idx"), F.col("n_words")
    return latest.join(counts, "doc_id").where((i > 0) & (i < n)).select(
        "user_id", "doc_id", "word_idx", "n_words",
        F.least((i / n * 100).cast("int"), F.lit(100)).alias("percent"))


def recents(positions: DataFrame, keep: int = RECENTS) -> DataFrame:
    """Most recent distinct documents per user, newest first."""
    last = positions.groupBy("user_id", "doc_id").agg(F.max(F.struct("ts", "event_id")).alias("at"))
    w = Window.partitionBy("user_id").orderBy(F.desc("at"))
    return last.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).select(
        "user_id", "rank", "doc_id")


def _play_spans(events: DataFrame) -> DataFrame:
    """Timed control events with the micros played until the next one and the session they are in."""
    timed = events.where(F.col("action").isin("play", "pause", "finish", "close")).withColumn(
        "us", F.unix_micros(F.col("ts").cast("timestamp"))).select("user_id", "ts", "event_id", "action", "us")
    ends = F.col("action").isin("finish", "close").cast("int")
    spans = with_time_span(timed, ["user_id"], "ts", "_span")
    nexts = scan(spans, ["user_id"], ["ts", "event_id"], F.col("_span"), sums={"session_no": ends},
                 nexts={"next": F.struct("action", "us")})
    played = (F.col("action") == "play") & F.col("next.action").isin("pause", "finish")
    return nexts.withColumn(
        "played_us", F.when(played, F.col("next.us") - F.col("us")).otherwise(F.lit(0)))


def reading_time(events: DataFrame) -> DataFrame:
    """Seconds between play and the pause or finish that follows it, per user."""
    return _play_spans(events).groupBy("user_id").agg(
        F.round(F.sum("played_us") / 1e6, 6).alias("reading_time_seconds"))


def finished_sessions(events: DataFrame) -> DataFrame:
    """One record per finished session; sessions closed before the end produce none."""
    return _play_spans(events).groupBy("user_id", "session_no").agg(
        F.round(F.sum("played_us") / 1e6, 6).alias("reading_time_seconds"),
        F.max(F.when(F.col("action") == "finish", F.col("us"))).alias("finished_us"),
    ).where(F.col("finished_us").isNotNull())


def source_progress(events: DataFrame, totals: DataFrame) -> DataFrame:
    """Start of the next session per user and source: resume, or restart after the end.

    totals: user_id, source, total_words; a source without a total has no end.
    """
    at = F.struct("ts", "event_id")
    last = events.groupBy("user_id", "source").agg(F.max_by(F.struct("action", "word_idx"), at).alias("e")) \
        .join(totals, ["user_id", "source"], "left")
    i = F.when(F.col("e.action") == "finish", 0).otherwise(F.col("e.word_idx"))
    resumes = (i > 0) & (F.col("total_words").isNull() | (i < F.col("total_words")))
    return last.select("user_id", "source", F.when(resumes, i).otherwise(0).alias("start_idx"),
                       F.when(resumes, "resume").otherwise("restart").alias("state"))


def by_source(sessions: DataFrame, cube: bool = False) -> DataFrame:
    """Session counts and words per source, or per source and day with all subtotals."""
    d = sessions.withColumn("day", day_of(F.col("finished_at")))
    grouped = d.cube("source", "day") if cube else d.groupBy("source")
    return grouped.agg(F.count("*").alias("n_sessions"), F.sum("total_words").alias("n_words"))
