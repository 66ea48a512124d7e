"""Streams with bounded state against batch results, with late rows."""

import datetime as dt
import random

from pyspark.sql import Row

from textpace.streaming import stateful

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "user_id BIGINT, ts TIMESTAMP, reading_time_seconds DOUBLE"


def batches(seed=1):
    """Five batches of events in rising time, and in the last also rows from weeks before."""
    rng, out = random.Random(seed), []
    for b in range(5):
        out.append([(rng.randint(1, 4), START + dt.timedelta(days=4 * b, minutes=rng.randint(0, 4000)), float(rng.randint(0, 300)))
                    for _ in range(60)])
    out[-1] += [(rng.randint(1, 4), START + dt.timedelta(minutes=rng.randint(0, 12000)), 60.0) for _ in range(25)]
    return out


def stream(spark, folder, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part{i}")
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    return files


def runs(rows, gap=30 * 60):
    out = []
    for user in sorted({u for u, _, _ in rows}):
        times = sorted(t for u, t, _ in rows if u == user)
        for i, t in enumerate(times):
            if i and (t - times[i - 1]).total_seconds() < gap:
                out[-1][2] += 1
            else:
                out.append([user, int(t.timestamp() * 1_000_000), 1])
    return sorted(map(tuple, out))


def test_sessions_with_late_rows(spark, tmp_path):
    parts = batches()
    out = stateful.run_sessions(stream(spark, tmp_path, parts), str(tmp_path / "run"), retention=dt.timedelta(days=2))
    log = spark.read.parquet(out)
    assert log.select("batch").distinct().count() >= 5 and log.where("change = 'late'").count() > 0
    got = stateful.sessions(spark, out).select("user_id", "start_us", "n_events")
    assert sorted(map(tuple, got.collect())) == runs([r for p in parts for r in p])
    # A batch logs what it changed: rows of a session that ended long before are not repeated.
    first = log.where("change = 'set' and batch = 0").select("user_id", "start_us")
    assert log.where("change = 'set' and batch > 2").join(first, ["user_id", "start_us"]).count() == 0


def test_late_event_joins_two_sessions(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    parts = [[(1, at(0), 1.0), (1, at(50), 1.0)], [(1, at(25), 1.0)], [(1, at(9000), 1.0)], [(1, at(70), 1.0), (1, at(99), 1.0), (1, at(200), 1.0)]]
    out = stateful.run_sessions(stream(spark, tmp_path, parts), str(tmp_path / "run"), retention=dt.timedelta(days=2))
    got = stateful.sessions(spark, out).select("user_id", "start_us", "n_events")
    assert sorted(map(tuple, got.collect())) == runs([r for p in parts for r in p])
    assert spark.read.parquet(out).where("change = 'gone'").count() == 1


def test_daily_activity_with_late_rows(spark, tmp_path):
    parts = batches(2)
    rows = stream(spark, tmp_path, parts).withColumnRenamed("ts", "finished_at")
    out = stateful.run_daily_activity(rows, str(tmp_path / "run"), dt.timedelta(days=2))
    assert spark.read.parquet(out).where("late").count() > 0
    want = {}
    for u, t, s in (r for p in parts for r in p):
        if s > 0:
            m, n = want.get((u, t.date()), (0.0, 0))
            want[u, t.date()] = (m + s / 60, n + 1)
    got = {(r.user_id, r.day): (round(r.minutes, 6), r.sessions) for r in stateful.daily_activity(spark, out).collect()}
    assert got == {k: (round(m, 6), n) for k, (m, n) in want.items()}


def test_state_of_a_user_is_read_and_written_once_a_batch():
    """Each call is a message to the JVM, and users come one after another."""
    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    sessions = stateful.Sessions(dt.timedelta(days=2), dt.timedelta(minutes=30))
    sessions.init(Handle())
    minutes = lambda *ms: iter([Row(user_id=7, us=m * 60_000_000) for m in ms])
    first = list(sessions.handleInputRows((7,), minutes(0, 100, 10), None))
    assert calls == ["get", "update"]
    assert [(r.start_us, r.n_events, r.change) for r in first] == [(0, 2, "set"), (100 * 60_000_000, 1, "set")]
    second = list(sessions.handleInputRows((7,), minutes(35), None))
    assert calls == ["get", "update"] * 2
    assert [(r.start_us, r.n_events, r.change) for r in second] == [(0, 3, "set")]
