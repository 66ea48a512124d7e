"""Live session statistics with Structured Streaming.

Every result equals the batch operator over the same rows. Output goes to tables in a shared
folder, never through the driver; progress is kept in the stream's checkpoint folder.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textpace.operators import sessions as S

# Sessions may be recorded for any date, so late rows are accepted for a long time.
LATENESS = "3650 days"
COMPACT_EVERY = 16


def read_events(spark: SparkSession, folder: str, glob: str, files_per_batch: int = 1) -> DataFrame:
    """Event files as a stream with event time as a timestamp."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).option(
        "maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_activity(sessions: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Minutes and session counts per user and tumbling day."""
    rows = sessions.where("reading_time_seconds > 0").withWatermark("finished_at", lateness)
    return rows.groupBy("user_id", F.window("finished_at", "1 day").alias("w")).agg(
        F.sum(F.col("reading_time_seconds") / 60.0).alias("minutes"), F.count("*").alias("sessions"))


def live_totals(sessions: DataFrame) -> DataFrame:
    """Running sums per user, from which totals and the weighted rate follow."""
    t = F.col("reading_time_seconds")
    return S.with_metrics(S.valid(sessions)).groupBy("user_id").agg(
        F.count("*").alias("n_sessions"), F.sum("total_words").alias("n_words"),
        F.sum(F.greatest(F.lit(0.0), F.col("saved_seconds"))).alias("saved_seconds"),
        F.sum(F.col("actual_wpm") * t).alias("weighted"), F.sum(t).alias("seconds"))


def assembled_sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Sessions of control events that lie closer than the gap."""
    return events.withWatermark("ts", lateness).groupBy(
        "user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"))


def once(sessions: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each session id once, however often it is delivered within the lateness."""
    return sessions.withWatermark("finished_at", lateness).dropDuplicatesWithinWatermark(["event_id"])


def run_updates(stream: DataFrame, folder: str, mode: str = "update",
                each: Callable[[DataFrame, int], DataFrame] | None = None) -> str:
    """Run a stream over all available input and keep each batch's rows with its number.

    A repeated batch overwrites its own folder, so a restart never doubles rows.
    """
    out = f"{folder}/out"

    def write(batch: DataFrame, number: int) -> None:
        rows = each(batch, number) if each else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (stream.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return out


def latest_updates(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last update of every key."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_m")).select(*keys, "_m.*")


def live_streaks(sessions: DataFrame, folder: str, as_of: dt.date) -> str:
    """Streaks of the users touched by each batch; a longest streak never falls.

    A batch adds one row per user and day to a daily table, then streaks of its users are
    recomputed from that table. Every ``COMPACT_EVERY`` batches the table is summed into one, so a
    batch reads at most that many small tables and one large one.
    """
    spark = sessions.sparkSession
    days = f"{folder}/days"

    def each(batch: DataFrame, number: int) -> DataFrame:
        def summed(first: int, last: int) -> DataFrame:
            parts = [f"{days}/batch={i}" for i in range(first, last)] + ([f"{days}/upto={first}"] if first else [])
            return spark.read.parquet(*parts)

        base = number - number % COMPACT_EVERY
        if number and number == base:
            summed(base - COMPACT_EVERY, base).groupBy("user_id", "day").agg(
                F.sum("minutes").alias("minutes"), F.sum("sessions").alias("sessions")
            ).write.mode("overwrite").parquet(f"{days}/upto={base}")
        S.daily(batch).write.mode("overwrite").parquet(f"{days}/batch={number}")
        known = summed(base, number + 1)
        touched = batch.select("user_id").distinct()
        merged = known.join(touched, "user_id", "left_semi").groupBy("user_id", "day").agg(
            F.sum("minutes").alias("minutes"), F.sum("sessions").alias("sessions"))
        return S.streaks(merged, as_of)

    return run_updates(sessions, folder, "append", each)


def live_positions(positions: DataFrame, folder: str) -> str:
    """Latest position per user and document in each batch; readers take the newest."""

    def each(batch: DataFrame, number: int) -> DataFrame:
        at = F.struct("ts", "event_id")
        return batch.groupBy("user_id", "doc_id").agg(
            F.max_by("word_idx", at).alias("word_idx"), F.max(at).alias("at"))

    return run_updates(positions, folder, "append", each)
