"""Streams fed file by file equal the batch result; stores and file sources keep whole data."""

import datetime as dt
import os

from pyspark.sql import functions as F

from textpace.operators import sessions as S
from textpace.sources import files
from textpace.sources.derived import control_events_from, sessions_from
from textpace.sources.sinks import PositionStore
from textpace.streaming import live

START = dt.datetime(2024, 1, 1)


def events(spark, n=400):
    kinds = ["view", "click", "purchase", "signup", "error"]
    rows = [(i, START + dt.timedelta(minutes=37 * i % 20000), i % 7, kinds[i * 3 % 5], float(i * 13 % 300) / 2, "") for i in range(n)]
    return spark.createDataFrame(rows, "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING")


def stream(spark, tmp_path):
    folder = str(tmp_path / "events")
    for part in range(3):
        events(spark).where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(folder)
    return live.read_events(spark, folder, "*.parquet")


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_live_daily_activity(spark, tmp_path):
    out = live.run_updates(live.daily_activity(sessions_from(stream(spark, tmp_path))), str(tmp_path / "st"))
    got = live.latest_updates(spark, out, ["user_id", "w"]).select(
        "user_id", F.to_date("w.start").alias("day"), F.round("minutes", 6).alias("minutes"), "sessions")
    assert rows_of(got) == rows_of(S.daily(sessions_from(events(spark))).withColumn("minutes", F.round("minutes", 6)))
    assert spark.read.parquet(out).select("batch").distinct().count() > 1


def test_live_streaks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "COMPACT_EVERY", 2)
    as_of = dt.date(2024, 1, 14)
    out = live.live_streaks(sessions_from(stream(spark, tmp_path)), str(tmp_path / "st"), as_of)
    got = spark.read.parquet(out).groupBy("user_id").agg(
        F.max_by("current_streak", "batch").alias("c"), F.max("longest_streak").alias("l"))
    assert rows_of(got) == rows_of(S.streaks(S.daily(sessions_from(events(spark))), as_of))


def test_live_sessions_and_duplicates(spark, tmp_path):
    twice = stream(spark, tmp_path).withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_n")
    out = live.run_updates(live.once(sessions_from(twice)), str(tmp_path / "st"), "append")
    assert rows_of(spark.read.parquet(out).select("event_id")) == rows_of(events(spark).select("event_id"))


def test_streaks_by_hand(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 3, 5, 6, 9)]
    df = spark.createDataFrame([(1, d, 1.0, 1) for d in days] + [(1, dt.date(2024, 1, 4), 0.05, 1), (2, days[0], 0.01, 1)],
                               "user_id INT, day DATE, minutes DOUBLE, sessions INT")
    at = lambda day: {r.user_id: (r.current_streak, r.longest_streak) for r in S.streaks(df, dt.date(2024, 1, day)).collect()}
    assert at(7) == {1: (2, 3), 2: (0, 0)}
    assert at(8) == {1: (0, 3), 2: (0, 0)}
    assert at(3) == {1: (3, 3), 2: (0, 0)}


def test_reading_time_spans(spark):
    acts = ["play", "pause", "play", "seek", "finish", "play", "close", "play", "play", "finish"]
    kinds = {"play": "view", "pause": "click", "seek": "signup", "close": "error", "finish": "purchase"}
    rows = [(i, START + dt.timedelta(minutes=50 * i), 1, kinds[a], 1.0, "") for i, a in enumerate(acts)]
    ev = control_events_from(spark.createDataFrame(rows, events(spark, 1).schema))
    assert S.reading_time(ev).first().reading_time_seconds == (50 + 100 + 50) * 60
    got = S.finished_sessions(ev).orderBy("session_no").collect()
    assert [(r.session_no, r.reading_time_seconds) for r in got] == [(0, 9000.0), (2, 3000.0)]


def test_position_store(spark, tmp_path):
    store = PositionStore(spark, str(tmp_path / "p"))
    t = lambda m: START + dt.timedelta(minutes=m)
    save = lambda *rows: store.save(spark.createDataFrame(list(rows), "user_id INT, doc_id INT, word_idx INT, ts TIMESTAMP"))
    save((1, 1, 5, t(1)), (1, 2, 9, t(1)))
    store.clear(spark.createDataFrame([(1, 2, t(5))], "user_id INT, doc_id INT, ts TIMESTAMP"))
    store.compact()
    save((1, 1, 7, t(9)), (1, 2, 3, t(2)))
    have = lambda: {(r.user_id, r.doc_id): r.word_idx for r in store.current().collect()}
    assert have() == {(1, 1): 7}
    save((1, 2, 4, t(6)))
    assert have() == {(1, 1): 7, (1, 2): 4}
    store.clear_all()
    assert have() == {}


def test_file_sources(spark, tmp_path):
    for name, data in {"a.txt": "Grüße".encode(), "b.b.txt": "Größe".encode("latin-1"), "c.txt": b" \n ", "d.md": b"# T\nx"}.items():
        with open(os.path.join(tmp_path, name), "wb") as f:
            f.write(data)
    got = {r.title: r.text for r in files.scan_texts(spark, str(tmp_path)).collect()}
    assert got == {"a": "Grüße", "b.b": "Größe"}
    assert [(r.title, r.text) for r in files.scan_markdown(spark, str(tmp_path)).collect()] == [("d", "# T\nx")]


def test_shared_folder_is_required_on_a_cluster(spark):
    from types import SimpleNamespace

    import pytest

    from textpace.session import shared_dir
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(cluster, "x")


def test_sources_without_total_resume(spark):
    import datetime as dt
    events = spark.createDataFrame([(1, s, "pause", 70, dt.datetime(2024, 1, 1), 1) for s in ("a", "b", "c")],
                                   "user_id INT, source STRING, action STRING, word_idx INT, ts TIMESTAMP, event_id INT")
    totals = spark.createDataFrame([(1, "a", 60), (1, "b", 80)], "user_id INT, source STRING, total_words INT")
    got = {r.source: r.state for r in S.source_progress(events, totals).collect()}
    assert got == {"a": "restart", "b": "resume", "c": "resume"}
