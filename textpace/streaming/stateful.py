"""Live results with bounded state per user.

Each user has a clock, the latest event time of the batches before. State reaches back from the clock
by a stated retention; what is older is forgotten. Each batch appends what it changed to a log, never
the whole result. A row older than the retention is not lost: it goes to the log as a correction, and
the readers below put corrections and changes together, so results always equal those of a batch run
over all rows.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textpace.operators.ordered import scan
from textpace.streaming.live import run_updates

RETENTION = dt.timedelta(days=7)
GAP = dt.timedelta(minutes=30)
DAY_US = 86_400_000_000
# Events of a user that are merged into the intervals at once.
CHUNK = 10_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

DAYS = "user_id bigint, day int, minutes double, sessions bigint, late boolean"
SESSIONS = "user_id bigint, start_us bigint, last_us bigint, n_events bigint, change string"


def _us(span: dt.timedelta) -> int:
    return span // dt.timedelta(microseconds=1)


class _PerUser(StatefulProcessor):
    """A clock and a short list of kept rows for each user.

    Both are one value, read once and written once a batch: each such call is a message to the JVM, and
    there is one user after another. Rows come one by one, since most users have few in a batch.
    """

    KEPT = ""
    OUT: tuple[str, ...] = ()

    def __init__(self, retention: dt.timedelta):
        self.retention = _us(retention)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", f"clock bigint, kept array<struct<{self.KEPT}>>")

    def _begin(self) -> tuple[int | None, list[tuple]]:
        held = self.state.get()
        return (None, []) if held is None else (held[0], [tuple(r) for r in held[1]])

    def _end(self, clock: int, kept: list[tuple]) -> None:
        self.state.update((clock, kept))

    def _rows(self, rows: list[tuple]) -> Iterator[Row]:
        return map(lambda values: Row(*self.OUT)(*values), rows)

    def close(self) -> None:
        pass


def _chunks(rows: Iterator[Row]) -> Iterator[list[Row]]:
    """Rows of a user, so many at a time that few are held at once."""
    return iter(lambda: list(islice(rows, CHUNK)), [])


class DailyActivity(_PerUser):
    """Minutes and sessions of each recent day."""

    KEPT = "day:int, minutes:double, sessions:bigint"
    OUT = ("user_id", "day", "minutes", "sessions", "late")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before, kept = self._begin()
        days = {d: (m, n) for d, m, n in kept}
        first = None if before is None else (before - self.retention) // DAY_US
        latest, changed, late = before, set(), {}
        for row in rows:
            latest = row.us if latest is None else max(latest, row.us)
            day = row.us // DAY_US
            old = late if first is not None and day < first else days
            minutes, sessions = old.get(day, (0.0, 0))
            old[day] = (minutes + row.minutes, sessions + 1)
            if old is days:
                changed.add(day)
        first = (latest - self.retention) // DAY_US
        self._end(latest, [(d, m, n) for d, (m, n) in sorted(days.items()) if d >= first])
        return self._rows([(key[0], d, *days[d], False) for d in sorted(changed)] + [(key[0], d, *v, True) for d, v in sorted(late.items())])


class Sessions(_PerUser):
    """Runs of events that lie closer than the gap, as intervals."""

    KEPT = "start:bigint, last:bigint, n:bigint"
    OUT = ("user_id", "start_us", "last_us", "n_events", "change")

    def __init__(self, retention: dt.timedelta, gap: dt.timedelta):
        super().__init__(retention)
        self.gap = _us(gap)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before, kept = self._begin()
        known, late, latest, spans = {s: (e, n) for s, e, n in kept}, [], before, list(kept)
        for chunk in _chunks(rows):
            us = sorted(row.us for row in chunk)
            latest = us[-1] if latest is None else max(latest, us[-1])
            if before is not None:
                on_time = bisect_left(us, before - self.retention)
                late += us[:on_time]
                us = us[on_time:]
            spans = self._merged(spans + [(x, x, 1) for x in us])
        now = {s: (e, n) for s, e, n in spans}
        reach = latest - self.retention - self.gap
        self._end(latest, [s for s in spans if s[1] >= reach])
        out = [(key[0], s, e, n, "set") for s, (e, n) in sorted(now.items()) if known.get(s) != (e, n)]
        out += [(key[0], s, None, None, "gone") for s in sorted(set(known) - set(now))]
        out += [(key[0], x, x, 1, "late") for x in late]
        return self._rows(out)

    def _merged(self, spans: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for s, e, n in sorted(spans):
            if out and s - out[-1][1] < self.gap:
                out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2] + n)
            else:
                out.append((s, e, n))
        return out


def _run(rows: DataFrame, processor: StatefulProcessor, schema: str, folder: str) -> str:
    spark = rows.sparkSession
    kept = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        changes = rows.groupBy("user_id").transformWithState(processor, schema, "Update", "None")
        return run_updates(changes, folder, "update")
    finally:
        spark.conf.set(PROVIDER, kept) if kept else spark.conf.unset(PROVIDER)


def run_daily_activity(sessions: DataFrame, folder: str, retention: dt.timedelta = RETENTION) -> str:
    """Log the days that each batch changes (user_id, finished_at, reading_time_seconds)."""
    rows = sessions.where("user_id is not null and finished_at is not null and reading_time_seconds > 0").select(
        F.col("user_id").cast("bigint").alias("user_id"), F.unix_micros("finished_at").alias("us"),
        (F.col("reading_time_seconds") / 60.0).alias("minutes"))
    return _run(rows, DailyActivity(retention), DAYS, folder)


def daily_activity(spark: SparkSession, out: str) -> DataFrame:
    """The days of the log: the last state of each, with its corrections added."""
    log = spark.read.parquet(out)
    at, last = F.col("batch"), F.struct("minutes", "sessions")
    days = log.groupBy("user_id", "day").agg(
        F.max_by(F.when(~F.col("late"), last), F.when(~F.col("late"), at)).alias("m"),
        F.sum(F.when(F.col("late"), F.col("minutes"))).alias("late_minutes"),
        F.sum(F.when(F.col("late"), F.col("sessions"))).alias("late_sessions"))
    zero = F.lit(0)
    return days.select(
        "user_id", F.date_from_unix_date("day").alias("day"),
        (F.coalesce("m.minutes", zero) + F.coalesce("late_minutes", zero)).alias("minutes"),
        (F.coalesce("m.sessions", zero) + F.coalesce("late_sessions", zero)).alias("sessions"))


def run_sessions(events: DataFrame, folder: str, gap: dt.timedelta = GAP, retention: dt.timedelta = RETENTION) -> str:
    """Log the sessions that each batch opens, extends or joins (user_id, ts)."""
    rows = events.where("user_id is not null and ts is not null").select(
        F.col("user_id").cast("bigint").alias("user_id"), F.unix_micros("ts").alias("us"))
    return _run(rows, Sessions(retention, gap), SESSIONS, folder)


def sessions(spark: SparkSession, out: str, gap: dt.timedelta = GAP) -> DataFrame:
    """The sessions of the log. Late events are intervals too, so merging intervals corrects them."""
    log = spark.read.parquet(out)
    late = F.col("change") == "late"
    last = log.where(~late).groupBy("user_id", "start_us").agg(
        F.max_by(F.struct("last_us", "n_events", "change"), "batch").alias("m")).where("m.change = 'set'").select(
        "user_id", "start_us", "m.last_us", "m.n_events")
    spans = last.unionByName(log.where(late).select("user_id", "start_us", "last_us", "n_events"))
    # A session opens where nothing is open: +1 at each start, -1 a gap after each end. Buckets of
    # days bound what one task orders, however many sessions a user has.
    ends = spans.select("user_id", (F.col("last_us") + _us(gap)).alias("at"), F.lit(-1).alias("step"))
    moves = spans.select("user_id", F.col("start_us").alias("at"), F.lit(1).alias("step"), "last_us", "n_events").unionByName(
        ends, allowMissingColumns=True)
    day, order = F.floor(F.col("at") / DAY_US), ["at", "step"]
    moves = scan(moves, ["user_id"], order, day, sums={"_open": F.col("step")}).withColumn(
        "_new", F.when((F.col("step") == 1) & (F.col("_open") == 0), 1).otherwise(0))
    numbered = scan(moves, ["user_id"], order, day, sums={"_s": F.col("_new")}, inclusive=True)
    return numbered.where("step = 1").groupBy("user_id", "_s").agg(
        F.min("at").alias("start_us"), F.max("last_us").alias("last_us"), F.sum("n_events").alias("n_events")).drop("_s")
