"""Session settings: defaults for a single machine, and folders that all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def settings(given: dict[str, str], cpus: int) -> dict[str, str]:
    """What to add to the settings that spark-submit or the environment has given.

    Sizes that suit one machine are added under a local master only, and nothing given is replaced.
    """
    added = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if is_local(given.get("spark.master", f"local[{cpus}]")):
        added |= {
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.textpace.scanTasks": str(cpus),
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        }
    return {k: v for k, v in added.items() if k not in given}


def build_session(app: str = "textpace", cpus: int | None = None) -> SparkSession:
    if "PYSPARK_GATEWAY_PORT" in os.environ:
        # Started by spark-submit: its settings are in the JVM that runs already.
        SparkContext._ensure_initialized()
    given = dict(SparkConf().getAll())
    if "SPARK_MASTER" in os.environ:
        given.setdefault("spark.master", os.environ["SPARK_MASTER"])
    builder = SparkSession.builder.appName(app)
    if "spark.master" in given:
        builder = builder.master(given["spark.master"])
    for key, value in settings(given, cpus or int(os.environ.get("BENCH_CPUS", "8"))).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def guard(spark: SparkSession) -> None:
    """Turn off partitioning-aware unions.

    Spark 4.1 can plan a union of equally hash-partitioned inputs as co-partitioned yet run it as a
    plain union; aggregates above it then see each key twice and joins double rows.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A folder for written tables: under spark.checkpoint.dir where the cluster names one.

    All folders of one application lie in one, named by it, which can go when it has ended. A local master without that setting, as in tests, uses a temporary folder. Any other master is
    refused: each executor would write to its own disk and later reads would miss rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/textpace-{spark.sparkContext.applicationId}/{purpose}-{os.urandom(6).hex()}"
    if not is_local(spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"textpace-{purpose}-")
