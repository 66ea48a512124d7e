"""Words, pivots and pause plans against plain loops."""

import math

from pyspark.sql import functions as F

from textpace.functions import pacing as P
from textpace.functions import words as W
from textpace.operators import pacing, search, tokens


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t STRING").select(column.alias("c")).first()[0]


def test_words(spark):
    text = 'See https://a.b/c?d=1, «Wow»! It costs $9.56 or 3,14 — well-known don\'t 😀 50%... "Hi" 1,2,3'
    assert one(spark, W.words(F.col("t")), text) == [
        "See", "https://a.b/c?d=1,", "«Wow»!", "It", "costs", "$9.56", "or", "3,14", "well-known", "don't", "😀",
        "50%...", '"Hi"', "1,2,3"]
    assert one(spark, W.words(F.col("t")), "“Hi” there") == ["Hi", "there"]
    assert one(spark, W.words(F.col("t"), True), "“Hi” there") == ["“Hi”", "there"]


def test_very_long_number_list_is_one_word(spark):
    text = ",".join(["7"] * 60000)
    assert one(spark, F.size(W.words(F.col("t"))), text) == 1


def test_ranges_cut_words(spark):
    text = " a, b--c \n\"d\" e"
    docs = spark.createDataFrame([(1, text)], "doc_id INT, text STRING")
    rows = tokens.token_ranges(docs).orderBy("word_idx").collect()
    assert [text[r.start:r.end] for r in rows] == [r.word for r in rows] == ["a,", "b", "c", '"d"', "e"]


def pivot(word):
    at = [i for i, c in enumerate(word) if c.isalnum()]
    n = len(word)
    first, last = (at[0], at[-1]) if at else (0, n - 1)
    core = last - first + 1
    p = first + (0 if core <= 1 else 1 if core <= 5 else 2 if core <= 8 else 3 if core <= 12 else 4 if core <= 17
                 else 5 if core == 18 else core // 2 if core <= 25 else int(core * 0.6))
    if p < n and not word[p].isalnum() and at:
        return min(at, key=lambda i: (abs(i - p), i))
    return min(p, n - 1)


def test_pivot(spark):
    words = ["a", "to", "word", "«quote»", "$9.56", "a...b", "ab--.--cd", "--", "x" * 18, "y" * 25, "z" * 40, "don't", "e-m-a-i-l-s"]
    rows = P.with_pivot(spark.createDataFrame([(w,) for w in words], "word STRING")).collect()
    assert {r.word: r.pivot for r in rows} == {w: pivot(w) for w in words}


def test_delay_order(spark):
    df = spark.createDataFrame([(w,) for w in ["word", "stop.", "wait...", "so…", "a,", "extraordinary", 'end."']], "w STRING")
    got = {r.w: r.d for r in df.select("w", F.round(P.word_delay(F.col("w"), 300), 6).alias("d")).collect()}
    assert got == {"word": 0.2, "stop.": 0.4, "wait...": 0.4, "so…": 0.3, "a,": 0.28, "extraordinary": 0.24, 'end."': 0.2}


def simulate(words, n, on, wpm=300, hold=5.0):
    out, i, resumed = [], 0, False
    delay = lambda w: 60 / wpm * (1 + max(0, len(w) - 8) * 0.04 + (1.0 if w[-1] in ".!?" else 0.4 if w[-1] in ",;:" else 0))
    while i < len(words):
        if words[i] in on:
            out.append((i, True, hold))
            i, resumed = i + 1, True
            continue
        chunk = words[i:i + n]
        d = 0.6 if resumed else max(map(delay, chunk)) * (1 + 0.3 * (len(chunk) - 1))
        out.append((i, False, round(d, 6)))
        i, resumed = i + n, False
    return out


def test_pause_plan(spark):
    text = "one two image three, four table formula five. six seven code eight image"
    docs = spark.createDataFrame([(1, text)], "doc_id INT, text STRING")
    on = {"image", "formula", "table"}
    for n in (1, 2, 3, 5):
        rows = pacing.pause_plan(docs, size=n).orderBy("word_idx").collect()
        assert [(r.word_idx, r.is_stop, round(r.delay, 6)) for r in rows] == simulate(text.split(), n, on), n


def test_schedule_and_chunk_one_is_plain_rate(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd ee")], "doc_id INT, text STRING")
    rows = pacing.schedule(docs, 300, 1).orderBy("chunk_id").collect()
    assert [round(r.end_s, 6) for r in rows] == [0.2, 0.4, 0.6, 0.8, 1.0]
    assert one(spark, P.remaining_time(F.lit(301), F.lit(0), 300, 1), "") == "1:00"


def test_search_occurrences_do_not_overlap(spark):
    docs = spark.createDataFrame([(1, "aaaa (A) $5 a.b")], "doc_id INT, text STRING")
    rows = search.occurrences(docs, ["aa", "(a)", "$", "", "a.b"]).collect()
    assert sorted((r.query_id, r.start, r.end) for r in rows) == [(0, 0, 2), (0, 2, 4), (1, 5, 8), (2, 9, 10), (4, 12, 15)]
    at = {(r.query_id, r.match_idx): r.word_idx for r in search.occurrence_words(docs, ["aa", "$", "("]).collect()}
    assert at == {(0, 0): 0, (0, 1): 0, (1, 0): 2, (2, 0): 1}


def test_formats(spark):
    cases = [(P.ceil_duration(F.lit(59.2)), "1 min"), (P.floor_duration(F.lit(61.9)), "1 min 1 sec"),
             (P.hours_minutes(F.lit(7322.0)), "2 h 2 min"), (P.short_number(F.lit(1234)), "1.2K"),
             (P.short_number(F.lit(3400000)), "3.4M"), (P.short_number(F.lit(12)), "12")]
    for column, want in cases:
        assert one(spark, column, "") == want
    assert math.isclose(one(spark, P.effective_wpm(300, 3), ""), 562.5)
