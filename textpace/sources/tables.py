"""Parquet table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textpace.session import guard

# Keys of the text tables that hold one row per key.
ROW_KEYS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table as it lies; ``spark.sql.files.maxPartitionBytes`` sets the size of its tasks.

    A session may ask for more tasks than its files give, as a single machine does that reads one
    file: ``spark.textpace.scanTasks`` then spreads the compact rows of any text table by key,
    whatever the size of the table.
    """
    guard(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.conf.get("spark.textpace.scanTasks", None)
    return rows.repartition(int(tasks), ROW_KEYS[name]) if tasks and name in ROW_KEYS else rows
