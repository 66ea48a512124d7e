"""Ordered scans over long groups.

A plain window keeps each whole group in one task. Where a group (a user, a
conversation) can hold a large share of all rows, the scan is split: rows are
windowed inside (group, bucket), each bucket is reduced to one row before the
shuffle, and only those bucket rows are scanned per group. The result equals the
plain window exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import MapType

from textpace.session import guard

# Rows of one group that a single window may hold when ordinals are dense.
SPAN = 4096
# Tasks for each shuffle partition where compact rows are to be exploded: a token row is many times its share of the text.
FINE = 16
# Bytes of input files for which there is one task at least, so that what a task holds does not grow with the input.
TASK_BYTES = 512 << 10


def input_bytes(df: DataFrame) -> int:
    """Size of the files that a table is read from; 0 where it comes from none."""
    spark, size = df.sparkSession, 0
    conf = spark._jsc.hadoopConfiguration()
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return size


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Place compact rows by key before they are exploded.

    The explode keeps the partitioning, so later windows on the same key need no
    further shuffle: one text row moves instead of thousands of token rows. What a task sorts is the
    exploded rows, so there are ``FINE`` tasks for each shuffle partition, and one for each ``TASK_BYTES``
    of input files, which no later step joins up by the size of the compact rows.
    """
    guard(df.sparkSession)
    tasks = FINE * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, -(-input_bytes(df) // TASK_BYTES)), *keys)


def span_bucket(ordinal: str, span: int = SPAN) -> Column:
    return F.floor(F.col(ordinal) / span)


def with_time_span(df: DataFrame, keys: list[str], ts: str, name: str, limit: int = SPAN) -> DataFrame:
    """Add a scan bucket of time: the hour, and the second as well where the key has over ``limit`` rows in
    that hour. A bucket holds at most ``limit`` rows or those of one second, and a key at most 3,600 buckets
    an hour. Hours are counted before any row moves, and only the busy ones take part in the join."""
    rows = df.withColumn("_hour", F.struct(*keys, F.date_trunc("hour", F.col(ts)).alias("_at")))
    busy = rows.groupBy("_hour").agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    second = F.when(F.col("_n").isNotNull(), F.date_trunc("second", F.col(ts)))
    return rows.join(busy, "_hour", "left").select(
        *[F.col(c) for c in df.columns], F.struct(F.col("_hour._at").alias("hour"), second.alias("second")).alias(name))


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    nexts: dict[str, Column] | None = None,
    inclusive: bool = False,
) -> DataFrame:
    """Add running sums and last non-null values of the rows before (or up to) each row, and next values.

    ``bucket`` must not decrease along ``order`` within a key. All of it is one pass: the rows are
    placed once by (key, bucket), and each bucket's last row holds its totals. Null keys are a key
    of their own and a null bucket comes first, as in a plain window.
    """
    sums, lasts, nexts = sums or {}, lasts or {}, nexts or {}
    b, place = "_bucket", "_place"
    # A struct is never null itself and equals another with nulls in the same fields, so the join
    # below keeps rows with null keys and adds no null test that would tell its branches apart.
    rows = df.withColumn(place, F.struct(*keys, bucket.alias(b)))
    here = Window.partitionBy(place).orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    before = upto if inclusive else here.rowsBetween(Window.unboundedPreceding, -1)
    # The hash, true of every row, names all columns: where a branch below had fewer, because a caller
    # drops some, it would get an exchange of its own and the input would be worked out twice.
    named = F.hash(*[f.name for f in rows.schema if not isinstance(f.dataType, MapType)]) >= -(1 << 31)
    local = rows.select(
        "*",
        *[F.sum(e).over(before).alias(f"_h_{n}") for n, e in sums.items()],
        *[F.last(e, ignorenulls=True).over(before).alias(f"_h_{n}") for n, e in lasts.items()],
        *[F.lead(e).over(here).alias(f"_h_{n}") for n, e in nexts.items()],
        *[F.sum(e).over(upto).alias(f"_t_{n}") for n, e in sums.items()],
        *[F.last(e, ignorenulls=True).over(upto).alias(f"_t_{n}") for n, e in lasts.items()],
        *[F.first(e).over(upto).alias(f"_t_{n}") for n, e in nexts.items()],
        F.lead(F.lit(True)).over(here).isNull().alias("_end"),
    ).where(named)
    spans = local.where("_end")
    after = Window.partitionBy(*[F.col(place)[k] for k in keys]).orderBy(F.col(place)[b])
    earlier = after.rowsBetween(Window.unboundedPreceding, -1)
    carry = spans.select(
        place,
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in lasts],
        *[F.lead(f"_t_{n}").over(after).alias(f"_c_{n}") for n in nexts],
    )
    zero = F.lit(0)
    return local.join(carry, place).select(
        *[F.col(c) for c in df.columns],
        *[(F.coalesce(F.col(f"_h_{n}"), zero) + F.coalesce(F.col(f"_c_{n}"), zero)).alias(n)
          for n in sums],
        *[F.coalesce(F.col(f"_h_{n}"), F.col(f"_c_{n}")).alias(n) for n in [*lasts, *nexts]],
    )


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    inclusive: bool = False,
) -> DataFrame:
    """Running sums and last non-null values over rows before (or up to) each row."""
    return scan(df, keys, order, bucket, sums, lasts, inclusive=inclusive)


def following(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, nexts: dict[str, Column]
) -> DataFrame:
    """The value of each (non-null) expression on the next row of the key."""
    return scan(df, keys, order, bucket, nexts=nexts)
