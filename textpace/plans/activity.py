"""Session, source, sink and streaming queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from textpace.functions import pacing as P
from textpace.operators import sessions as S
from textpace.plans.inputs_sql import CONTROL, POSITIONS, SESSIONS
from textpace.plans.registry import query
from textpace.session import shared_dir
from textpace.sources import files
from textpace.sources.derived import (control_events, control_events_from, positions, sessions, sessions_from)
from textpace.sources.sinks import PositionStore, append_sessions
from textpace.sources.tables import table
from textpace.streaming import live, stateful

AS_OF, EARLIER = dt.date(2024, 1, 31), dt.date(2024, 1, 15)
VALID = f"""{SESSIONS}, valid AS (SELECT * FROM sessions WHERE reading_time_seconds >= 5 AND total_words >= 10),
hist AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY finished_at DESC, event_id DESC) AS rank FROM valid) WHERE rank <= {{keep}}),
metr AS (SELECT *, CASE WHEN reading_time_seconds > 0 THEN least(configured_wpm, trunc(total_words / (reading_time_seconds / 60))::INT)
    ELSE configured_wpm END AS actual_wpm, total_words / 250::DOUBLE * 60 AS usual_seconds,
    total_words / 250::DOUBLE * 60 - reading_time_seconds AS saved_seconds FROM {{src}})"""


def _v(src="sessions", keep=200):
    return VALID.format(src=src, keep=keep)


DAILY = f"""{SESSIONS}, daily AS (SELECT user_id, finished_at::DATE AS day, sum(reading_time_seconds / 60) AS minutes, count(*) AS sessions
  FROM sessions WHERE reading_time_seconds > 0 GROUP BY ALL)"""


@query("a1_valid_sessions", f"WITH {_v()} SELECT event_id, user_id, total_words FROM valid")
def a1(spark, sf):
    return S.valid(sessions(spark, sf)).select("event_id", "user_id", "total_words")


@query("a2_session_metrics", f"""
WITH {_v()} SELECT event_id, actual_wpm, round(usual_seconds, 4) AS usual_seconds, round(saved_seconds, 4) AS saved_seconds FROM metr
""")
def a2(spark, sf):
    return S.with_metrics(sessions(spark, sf)).select(
        "event_id", "actual_wpm", F.round("usual_seconds", 4).alias("usual_seconds"),
        F.round("saved_seconds", 4).alias("saved_seconds"))


@query("a3_bounded_history", f"WITH {_v(keep=20)} SELECT user_id, event_id, rank FROM hist")
def a3(spark, sf):
    return S.history(sessions(spark, sf), 20).select("user_id", "event_id", "rank")


@query("a4_a5_totals", f"""
WITH {_v('hist')} SELECT user_id, count(*) AS n_sessions, sum(total_words)::BIGINT AS n_words,
  round(sum(greatest(0::DOUBLE, saved_seconds)), 4) AS saved_seconds,
  CASE WHEN sum(reading_time_seconds) > 0 THEN floor(sum(actual_wpm * reading_time_seconds) / sum(reading_time_seconds) + 1e-9) ELSE 0 END::INT AS average_wpm
FROM metr GROUP BY user_id
""")
def a4(spark, sf):
    return S.totals(S.history(sessions(spark, sf)))


@query("a6_daily_activity", f"WITH {DAILY} SELECT user_id, day::VARCHAR AS day, round(minutes, 6) AS minutes, sessions FROM daily")
def a6(spark, sf):
    return S.daily(sessions(spark, sf)).select(
        "user_id", F.col("day").cast("string").alias("day"), F.round("minutes", 6).alias("minutes"), "sessions")


@query("a7_backfilled_daily_activity", f"""
WITH {_v('hist')} SELECT user_id, finished_at::DATE::VARCHAR AS day, round(sum(reading_time_seconds / 60), 6) AS minutes, count(*) AS sessions FROM hist GROUP BY ALL
""")
def a7(spark, sf):
    return S.daily(S.history(sessions(spark, sf))).select(
        "user_id", F.col("day").cast("string").alias("day"), F.round("minutes", 6).alias("minutes"), "sessions")


@query("a8_active_days", f"WITH {DAILY} SELECT user_id, day::VARCHAR AS day FROM daily WHERE minutes >= 0.1")
def a8(spark, sf):
    return S.active(S.daily(sessions(spark, sf))).select("user_id", F.col("day").cast("string").alias("day"))


def _streak_sql(as_of):
    return f"""
WITH {DAILY}, a AS (SELECT user_id, day, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS run FROM daily WHERE minutes >= 0.1),
i AS (SELECT user_id, run, count(*) AS n FROM a GROUP BY ALL),
c AS (SELECT user_id, run, count(*) AS n, max(day) AS last FROM a WHERE day <= DATE '{as_of}' GROUP BY ALL)
SELECT u.user_id, coalesce((SELECT max(n) FROM c WHERE c.user_id = u.user_id AND last >= DATE '{as_of}' - 1), 0) AS current_streak,
  coalesce((SELECT max(n) FROM i WHERE i.user_id = u.user_id), 0) AS longest_streak
FROM (SELECT DISTINCT user_id FROM daily) u
"""


@query("a9_a10_streaks", _streak_sql(AS_OF))
def a9(spark, sf):
    return S.streaks(S.daily(sessions(spark, sf)), AS_OF)


@query("a9_a10_streaks_inside_data", _streak_sql(EARLIER))
def a9b(spark, sf):
    return S.streaks(S.daily(sessions(spark, sf)), EARLIER)


@query("a11_activity_totals", f"""
WITH {DAILY} SELECT user_id, count(*) FILTER (WHERE minutes >= 0.1) AS active_days, round(sum(minutes), 4) AS minutes FROM daily GROUP BY user_id
""")
def a11(spark, sf):
    return S.activity_totals(S.daily(sessions(spark, sf)))


CAL = f"""{DAILY}, cal AS (SELECT u.user_id, k AS idx, (DATE '{AS_OF}' - ({{n}} - 1) + k::INT)::DATE AS day
  FROM (SELECT DISTINCT user_id FROM daily) u, unnest(range({{n}})) AS r(k)),
full_cal AS (SELECT cal.*, coalesce(minutes, 0) AS minutes, coalesce(sessions, 0) AS sessions FROM cal LEFT JOIN daily USING (user_id, day))"""


@query("a12_dense_calendar", f"WITH {CAL.format(n=45)} SELECT user_id, idx, day::VARCHAR AS day, round(minutes, 6) AS minutes, sessions FROM full_cal")
def a12(spark, sf):
    return S.calendar(S.daily(sessions(spark, sf)), AS_OF, 45).select(
        "user_id", "idx", F.col("day").cast("string").alias("day"), F.round("minutes", 6).alias("minutes"), "sessions")


@query("a13_a14_heatmap", f"""
WITH {CAL.format(n=56)}
SELECT user_id, idx, idx // 7 AS week, idx % 7 AS row, day::VARCHAR AS day,
  CASE WHEN minutes < 0.1 THEN 0 WHEN minutes < 15 THEN 1 WHEN minutes < 30 THEN 2 WHEN minutes < 60 THEN 3 ELSE 4 END AS bucket,
  CASE WHEN coalesce(lag(month(day)) OVER (PARTITION BY user_id ORDER BY idx) <> month(day), TRUE) THEN strftime(day, '%b') END AS month_label
FROM full_cal
""")
def a13(spark, sf):
    return S.heatmap(S.daily(sessions(spark, sf)), AS_OF, 8).withColumn("day", F.col("day").cast("string"))


LATEST = f"{POSITIONS}, latest AS (SELECT user_id, doc_id, arg_max(word_idx, (ts, event_id)) AS word_idx FROM positions GROUP BY ALL)"


@query("a15_resumable_positions", f"""
WITH {LATEST}, d AS (SELECT doc_id, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n_words FROM documents)
SELECT user_id, doc_id, word_idx, n_words, least(trunc(word_idx / n_words::DOUBLE * 100), 100)::INT AS percent
FROM latest JOIN d USING (doc_id) WHERE word_idx > 0 AND word_idx < n_words
""")
def a15(spark, sf):
    return S.resumable(S.latest_positions(positions(spark, sf)), table(spark, sf, "documents"))


@query("a16_recent_documents", f"""
WITH {POSITIONS}, l AS (SELECT user_id, doc_id, max((ts, event_id)) AS seen FROM positions GROUP BY ALL)
SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC) AS rank, doc_id FROM l) WHERE rank <= 10
""")
def a16(spark, sf):
    return S.recents(positions(spark, sf))


SPANS = f"""{CONTROL}, timed AS (SELECT *, epoch_us(ts) AS us FROM control WHERE action IN ('play', 'pause', 'finish', 'close')),
nx AS (SELECT *, lead(action) OVER w AS na, lead(us) OVER w AS nu FROM timed WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
spans AS (SELECT *, CASE WHEN action = 'play' AND na IN ('pause', 'finish') THEN nu - us ELSE 0 END AS played FROM nx)"""


@query("a17_reading_time", f"WITH {SPANS} SELECT user_id, round(sum(played) / 1e6::DOUBLE, 6) AS reading_time_seconds FROM spans GROUP BY user_id")
def a17(spark, sf):
    return S.reading_time(control_events(spark, sf))


@query("a18_finished_sessions", f"""
WITH {SPANS}, s AS (SELECT *, coalesce(sum(CASE WHEN action IN ('finish', 'close') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS session_no FROM spans)
SELECT user_id, session_no, round(sum(played) / 1e6::DOUBLE, 6) AS reading_time_seconds, max(us) FILTER (WHERE action = 'finish') AS finished_us
FROM s GROUP BY user_id, session_no HAVING count(*) FILTER (WHERE action = 'finish') > 0
""")
def a18(spark, sf):
    return S.finished_sessions(control_events(spark, sf))


@query("a19_source_progress", f"""
WITH {CONTROL}, l AS (SELECT user_id, source, arg_max(action, (ts, event_id)) AS action, arg_max(word_idx, (ts, event_id)) AS word_idx FROM control GROUP BY ALL),
t AS (SELECT user_id, source, max(word_idx) // 2 + max(user_id) % 50 AS total FROM control WHERE user_id % 5 <> 0 GROUP BY user_id, source),
p AS (SELECT user_id, source, CASE WHEN action = 'finish' THEN 0 ELSE word_idx END AS i, coalesce(total, 1000000000) AS total FROM l LEFT JOIN t USING (user_id, source))
SELECT user_id, source, CASE WHEN i > 0 AND i < total THEN i ELSE 0 END AS start_idx, CASE WHEN i > 0 AND i < total THEN 'resume' ELSE 'restart' END AS state FROM p
""")
def a19(spark, sf):
    events = control_events(spark, sf)
    totals = events.where("user_id % 5 <> 0").groupBy("user_id", "source").agg(
        (F.floor(F.max("word_idx") / 2) + F.col("user_id") % 50).alias("total_words"))
    return S.source_progress(events, totals)


@query("a20_sessions_by_source", f"WITH {SESSIONS} SELECT source, count(*) AS n_sessions, sum(total_words)::BIGINT AS n_words FROM sessions GROUP BY source")
def a20(spark, sf):
    return S.by_source(sessions(spark, sf))


@query("a20_sessions_by_source_and_day", f"""
WITH {SESSIONS} SELECT source, finished_at::DATE::VARCHAR AS day, count(*) AS n_sessions, sum(total_words)::BIGINT AS n_words
FROM sessions GROUP BY CUBE (source, finished_at::DATE)
""")
def a20c(spark, sf):
    return S.by_source(sessions(spark, sf), cube=True).withColumn("day", F.col("day").cast("string"))


@query("a21_human_formats", """
WITH t AS (SELECT event_id, value * 37 AS v, floor(value * 37)::BIGINT AS f, ceil(value * 37)::BIGINT AS c, (event_id * 977) AS n FROM events)
SELECT event_id, CASE WHEN f // 60 > 0 THEN printf('%d min %d sec', f // 60, f % 60) ELSE printf('%d sec', f % 60) END AS floor_text,
  CASE WHEN c // 60 > 0 AND c % 60 > 0 THEN printf('%d min %d sec', c // 60, c % 60) WHEN c // 60 > 0 THEN printf('%d min', c // 60) ELSE printf('%d sec', c % 60) END AS ceil_text,
  CASE WHEN f // 3600 > 0 THEN printf('%d h %d min', f // 3600, f % 3600 // 60) ELSE printf('%d min', f % 3600 // 60) END AS hours_text,
  CASE WHEN n >= 1000000 THEN 'M' WHEN n >= 1000 THEN 'K' ELSE n::VARCHAR END AS number_unit
FROM t
""")
def a21(spark, sf):
    v, n = F.col("value") * 37, F.col("event_id") * 977
    return table(spark, sf, "events").select(
        "event_id", P.floor_duration(v).alias("floor_text"), P.ceil_duration(v).alias("ceil_text"),
        P.hours_minutes(v).alias("hours_text"),
        F.when(n >= 1000, F.regexp_extract(P.short_number(n), "[KM]$", 0)).otherwise(P.short_number(n)).alias("number_unit"))


# --- sources and sinks -------------------------------------------------------------------------

@query("src1_text_decoding", """
SELECT '/corpus/' || lang || '/doc.' || doc_id || '.txt' AS path, 'doc.' || doc_id AS title, text FROM documents
""")
def src1(spark, sf):
    docs = table(spark, sf, "documents")
    latin = F.col("lang").isin("de", "fr") & (F.encode("text", "ISO-8859-1").isNotNull())
    raw = F.when(latin & F.decode(F.encode("text", "ISO-8859-1"), "ISO-8859-1").eqNullSafe(F.col("text"))
                 & ~F.is_valid_utf8(F.encode("text", "ISO-8859-1").cast("string")),
                 F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    path = F.concat(F.lit("/corpus/"), F.col("lang"), F.lit("/doc."), F.col("doc_id").cast("string"), F.lit(".txt"))
    return files.decode_texts(docs.select(path.alias("path"), raw.alias("content")))


EXTS = ["txt", "MD", "markdown", "fb2", "EPUB", "docx", "pdf", "PNG", "jpg", "jpeg", "heic", "tiff", "bmp", "gif", "zip", ""]


@query("src2_src4_format_routing", f"""
WITH p AS (SELECT page_id, '/books/a.b/part ' || page_id || CASE WHEN e = '' THEN '' ELSE '.' || e END AS path, lower(e) AS e
  FROM (SELECT page_id, [{', '.join(repr(e) for e in EXTS)}][page_id % 16 + 1] AS e FROM pages))
SELECT page_id, path, 'part ' || page_id AS title, CASE WHEN e = 'txt' THEN 'text' WHEN e IN ('md', 'markdown') THEN 'markdown'
  WHEN e IN ('fb2', 'epub', 'docx', 'pdf') THEN e WHEN e IN ('', 'zip') THEN NULL ELSE 'image' END AS format FROM p
""")
def src2(spark, sf):
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTS]), (F.col("page_id") % 16 + 1).cast("int"))
    path = F.concat(F.lit("/books/a.b/part "), F.col("page_id").cast("string"),
                    F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    named = table(spark, sf, "pages").select("page_id", path.alias("path"))
    good, rejected = files.route(named)
    both = good.unionByName(rejected.withColumn("format", F.lit(None).cast("string")))
    return both.select("page_id", "path", files.title_of(F.col("path")).alias("title"), "format")


@query("src3_markdown_files", "SELECT 'doc-' || doc_id AS title, text FROM documents")
def src3(spark, sf):
    path = F.concat(F.lit("/notes/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return files.markdown_texts(table(spark, sf, "documents").select(path.alias("path"), "text")).select("title", "text")


@query("src5_page_scan", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def src5(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.length("html").alias("n_chars"))


@query("snk1_session_log", f"WITH {_v()} SELECT event_id, user_id, finished_at::DATE::VARCHAR AS day FROM valid")
def snk1(spark, sf):
    folder = shared_dir(spark, "sessions")
    rows = S.valid(sessions(spark, sf))
    append_sessions(rows.where("event_id % 2 = 0"), folder)
    append_sessions(rows.where("event_id % 2 = 1"), folder)
    return spark.read.parquet(folder).select("event_id", "user_id", F.col("day").cast("string").alias("day"))


@query("snk2_position_store", f"""
WITH {POSITIONS}, log AS (SELECT user_id, doc_id, ts, CASE WHEN event_id % 10 <> 7 THEN word_idx END AS word_idx FROM positions),
l AS (SELECT user_id, doc_id, arg_max(ROW(word_idx), ts) AS r FROM log GROUP BY ALL)
SELECT user_id, doc_id, r[1] AS word_idx FROM l WHERE r[1] IS NOT NULL
""")
def snk2(spark, sf):
    store = PositionStore(spark, shared_dir(spark, "positions"))
    rows = positions(spark, sf)
    gone = F.col("event_id") % 10 == 7
    store.save(rows.where(~gone & (F.col("event_id") % 2 == 0)))
    store.clear(rows.where(gone))
    store.compact()
    store.save(rows.where(~gone & (F.col("event_id") % 2 == 1)))
    return store.current().select("user_id", "doc_id", "word_idx")


# --- streaming ---------------------------------------------------------------------------------

def _events(spark, sf):
    """Events as four files, so that each query sees several batches."""
    folder = shared_dir(spark, "event-files")
    table(spark, sf, "events").repartitionByRange(4, "ts", "event_id").write.parquet(folder)
    return live.read_events(spark, folder, "*.parquet")


@query("st1_live_daily_activity", f"WITH {DAILY} SELECT user_id, day::VARCHAR AS day, round(minutes, 6) AS minutes, sessions FROM daily")
def st1(spark, sf):
    out = live.run_updates(live.daily_activity(sessions_from(_events(spark, sf))), shared_dir(spark, "st1"))
    return live.latest_updates(spark, out, ["user_id", "w"]).select(
        "user_id", F.date_format("w.start", "yyyy-MM-dd").alias("day"), F.round("minutes", 6).alias("minutes"), "sessions")


@query("st2_live_streaks", _streak_sql(AS_OF))
def st2(spark, sf):
    out = live.live_streaks(sessions_from(_events(spark, sf)), shared_dir(spark, "st2"), AS_OF)
    rows = spark.read.parquet(out)
    return rows.groupBy("user_id").agg(F.max_by("current_streak", "batch").alias("current_streak"),
                                       F.max("longest_streak").alias("longest_streak"))


@query("st3_live_totals", f"""
WITH {_v('valid')} SELECT user_id, count(*) AS n_sessions, sum(total_words)::BIGINT AS n_words, round(sum(greatest(0::DOUBLE, saved_seconds)), 4) AS saved_seconds,
  floor(sum(actual_wpm * reading_time_seconds) / sum(reading_time_seconds) + 1e-9)::INT AS average_wpm FROM metr GROUP BY user_id
""")
def st3(spark, sf):
    out = live.run_updates(live.live_totals(sessions_from(_events(spark, sf))), shared_dir(spark, "st3"))
    return live.latest_updates(spark, out, ["user_id"]).select(
        "user_id", "n_sessions", "n_words", F.round("saved_seconds", 4).alias("saved_seconds"),
        F.floor(F.col("weighted") / F.col("seconds") + 1e-9).cast("int").alias("average_wpm"))


@query("st4_live_positions", f"WITH {LATEST} SELECT user_id, doc_id, word_idx FROM latest")
def st4(spark, sf):
    n = table(spark, sf, "documents").agg(F.count("*")).scalar()
    pos = _events(spark, sf).select("event_id", "user_id", (F.col("event_id") % n).alias("doc_id"),
                                    F.floor("value").cast("int").alias("word_idx"), "ts")
    out = live.live_positions(pos, shared_dir(spark, "st4"))
    return spark.read.parquet(out).groupBy("user_id", "doc_id").agg(F.max_by("word_idx", "at").alias("word_idx"))


@query("st5_session_assembly", f"""
WITH {CONTROL}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM control WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n_events FROM n GROUP BY user_id, k
""")
def st5(spark, sf):
    found = live.assembled_sessions(control_events_from(_events(spark, sf)))
    out = live.run_updates(found, shared_dir(spark, "st5"), "complete")
    return live.latest_updates(spark, out, ["user_id", "w"]).select(
        "user_id", F.unix_micros("w.start").alias("start_us"), "n_events")


@query("st6_deduplicated_sessions", f"WITH {SESSIONS} SELECT event_id, user_id, total_words FROM sessions")
def st6(spark, sf):
    twice = _events(spark, sf).withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_n")
    out = live.run_updates(live.once(sessions_from(twice)), shared_dir(spark, "st6"), "append")
    return spark.read.parquet(out).select("event_id", "user_id", "total_words")


# One row in nine arrives with the last batch, up to weeks late, and is put right by the readers.
def _late_events(spark, sf):
    folder = shared_dir(spark, "event-files")
    events = table(spark, sf, "events").withColumn("_late", (F.col("event_id") % 9 == 4).cast("int"))
    events.repartitionByRange(5, "_late", "ts", "event_id").drop("_late").write.parquet(folder)
    return live.read_events(spark, folder, "*.parquet")


@query("st1_daily_activity_with_late_rows", f"WITH {DAILY} SELECT user_id, day::VARCHAR AS day, round(minutes, 6) AS minutes, sessions FROM daily")
def st1_late(spark, sf):
    out = stateful.run_daily_activity(sessions_from(_late_events(spark, sf)), shared_dir(spark, "st1-late"), dt.timedelta(days=2))
    return stateful.daily_activity(spark, out).select(
        "user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("minutes", 6).alias("minutes"), "sessions")


@query("st5_session_assembly_with_late_rows", f"""
WITH {CONTROL}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM control WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n_events FROM n GROUP BY user_id, k
""")
def st5_late(spark, sf):
    out = stateful.run_sessions(control_events_from(_late_events(spark, sf)), shared_dir(spark, "st5-late"), retention=dt.timedelta(days=2))
    return stateful.sessions(spark, out).select("user_id", "start_us", "n_events")
