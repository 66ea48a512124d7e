"""Pivot, delay and time expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textpace.functions.words import ALNUM, NON_ALNUM

# --- fixed values: reading speed rules ---
TRADITIONAL_WPM = 250
DEFAULT_WPM = 300
WPM_RANGE = (100, 1000)
CHUNK_RANGE = (1, 7)
PAUSE_RANGE = (2.0, 15.0)
DEFAULT_PAUSE = 5.0
RESUME_BEAT = 0.6
CHUNK_STRETCH = 0.3
AUTO_PAUSE = {"image": True, "formula": True, "table": True, "code": False}
# --- end of fixed values ---


def _col(x):
    return x if isinstance(x, Column) else F.lit(x)


def clamp(x, lo, hi) -> Column:
    return F.greatest(_col(lo), F.least(_col(hi), _col(x)))


def clamp_wpm(x) -> Column:
    return clamp(x, *WPM_RANGE)


def clamp_chunk(x) -> Column:
    return clamp(x, *CHUNK_RANGE)


def clamp_pause(x) -> Column:
    return clamp(x, *PAUSE_RANGE)


def clamp_index(i, n) -> Column:
    return clamp(i, 0, _col(n) - 1)


def core_pivot(n: Column) -> Column:
    return (
        F.when(n <= 1, 0).when(n <= 5, 1).when(n <= 8, 2).when(n <= 12, 3).when(n <= 17, 4)
        .when(n == 18, 5).when(n <= 25, F.floor(n / 2).cast("int"))
        .otherwise(F.floor(n * F.lit(0.6)).cast("int"))
    )


def _nearest_alnum(word: Column, p: Column) -> Column:
    """Index of the letter or digit nearest to p; the left one wins a tie."""
    n = F.length(word)
    return F.array_min(
        F.transform(
            F.filter(
                F.sequence(F.lit(0), n - 1),
                lambda i: F.substring(word, i + 1, F.lit(1)).rlike(ALNUM),
            ),
            lambda i: F.struct(F.abs(i - p).alias("gap"), i.alias("at")),
        )
    )["at"]


def with_pivot(df: DataFrame, word: str = "word") -> DataFrame:
    """Add core_length, raw_pivot and the repaired pivot.

    The stages are separate projections so that each pattern runs once per word.
    """
    w, n = F.col(word), F.length(word)
    edges = df.select(
        "*",
        F.length(F.regexp_extract(w, f"^{NON_ALNUM}*", 0)).alias("_lead"),
        F.length(F.regexp_extract(w, f"{NON_ALNUM}*$", 0)).alias("_trail"),
    )
    bare = F.col("_lead") == n
    core = edges.select(
        *[F.col(c) for c in df.columns],
        F.when(bare, 0).otherwise(F.col("_lead")).alias("_lead"),
        F.when(bare, n).otherwise(n - F.col("_lead") - F.col("_trail")).alias("core_length"),
    )
    raw = core.select(
        *[F.col(c) for c in df.columns], "core_length",
        F.when(n == 0, 0).otherwise(F.col("_lead") + core_pivot(F.col("core_length")))
        .alias("raw_pivot"),
    )
    p = F.col("raw_pivot")
    misses = (p < n) & ~F.substring(w, p + 1, F.lit(1)).rlike(ALNUM)
    return raw.withColumn(
        "pivot",
        F.when(n == 0, 0).when(misses, F.coalesce(_nearest_alnum(w, p), F.least(p, n - 1)))
        .otherwise(F.least(p, n - 1)),
    )


def split_at_pivot(word: Column, at: Column) -> Column:
    n = F.length(word)
    return F.struct(
        F.substring(word, F.lit(1), at).alias("before"),
        F.substring(word, at + 1, F.lit(1)).alias("pivot_char"),
        F.substring(word, at + 2, n).alias("after"),
    )


def delay_factor(word: Column) -> Column:
    """1 + long-word share + closing punctuation, checked in this order."""
    end = F.right(word, F.lit(1))
    return (
        F.lit(1.0)
        + F.greatest(F.length(word) - 8, F.lit(0)) * F.lit(0.04)
        + F.when(end.isin(".", "!", "?"), 1.0)
        .when(end.isin(",", ";", ":"), 0.4)
        .when(end.isin("—", "–"), 0.4)
        .when(end == "…", 0.5)
        .otherwise(0.0)
    )


def word_delay(word: Column, wpm=DEFAULT_WPM) -> Column:
    return F.lit(60.0) / _col(wpm) * delay_factor(word)


def chunk_delay(max_word_delay: Column, size: Column) -> Column:
    return max_word_delay * (F.lit(1.0) + F.lit(CHUNK_STRETCH) * (size - 1))


def effective_wpm(wpm, chunk) -> Column:
    n = _col(chunk).cast("double")
    return _col(wpm) * n / (F.lit(1.0) + F.lit(CHUNK_STRETCH) * (n - 1))


def minutes_seconds(total: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(total / 60).cast("int"), (total % 60).cast("int"))


def remaining_time(n_words: Column, idx: Column, wpm=DEFAULT_WPM, chunk=1) -> Column:
    left = n_words - 1 - idx
    secs = F.ceil(left / effective_wpm(wpm, chunk) * 60.0)
    return F.when(left <= 0, F.lit("0:00")).otherwise(minutes_seconds(secs))


def progress(n_words: Column, idx: Column) -> Column:
    return (
        F.when(n_words <= 0, F.lit(0.0))
        .when(n_words == 1, F.when(idx == 0, 0.0).otherwise(100.0))
        .otherwise(idx / (n_words - 1) * 100.0)
    )


def scrub_tooltip(ratio: Column, n_words: Column, wpm=DEFAULT_WPM) -> Column:
    target = F.floor(ratio * F.greatest(F.lit(0), n_words - 1))
    minutes = F.greatest(F.lit(0), n_words - target) / F.greatest(F.lit(1), _col(wpm))
    label = F.when(minutes < 1, F.lit("< 1 min")).otherwise(
        F.format_string("~%d min", F.ceil(minutes))
    )
    return F.format_string("%d%% · %s", F.round(ratio * 100).cast("int"), label)


def ceil_duration(seconds: Column) -> Column:
    total = F.ceil(seconds)
    m, s = F.floor(total / 60), total % 60
    return (
        F.when((m > 0) & (s > 0), F.format_string("%d min %d sec", m, s))
        .when(m > 0, F.format_string("%d min", m))
        .otherwise(F.format_string("%d sec", s))
    )


def floor_duration(seconds: Column) -> Column:
    total = F.floor(seconds)
    m, s = F.floor(total / 60), total % 60
    return F.when(m > 0, F.format_string("%d min %d sec", m, s)).otherwise(
        F.format_string("%d sec", s)
    )


def hours_minutes(seconds: Column) -> Column:
    total = F.floor(seconds)
    h, m = F.floor(total / 3600), F.floor((total % 3600) / 60)
    return F.when(h > 0, F.format_string("%d h %d min", h, m)).otherwise(
        F.format_string("%d min", m)
    )


def short_number(n: Column) -> Column:
    return (
        F.when(n >= 1000000, F.format_string("%.1fM", n / 1000000.0))
        .when(n >= 1000, F.format_string("%.1fK", n / 1000.0))
        .otherwise(n.cast("string"))
    )


def time_savings(n_words: Column, wpm=DEFAULT_WPM) -> Column:
    """Struct of usual time, paced time, saving, multiplier and display text; null where invalid."""
    w = _col(wpm)
    usual = n_words / F.lit(float(TRADITIONAL_WPM)) * 60.0
    paced = n_words / w.cast("double") * 60.0
    saved = usual - paced
    times = w.cast("double") / F.lit(float(TRADITIONAL_WPM))
    plain = F.concat(F.lit("Normal: "), ceil_duration(usual), F.lit(" · App: "), ceil_duration(paced))
    text = F.when(
        saved > 0,
        F.concat(plain, F.lit(" · Save "), ceil_duration(F.abs(saved)),
                 F.format_string(" (%.1f×)", times)),
    ).otherwise(plain)
    return F.when(
        (n_words > 0) & (w > 0),
        F.struct(usual.alias("usual_seconds"), paced.alias("paced_seconds"),
                 saved.alias("saved_seconds"), times.alias("multiplier"), text.alias("label")),
    )
