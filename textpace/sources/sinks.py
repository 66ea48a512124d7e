"""Session log and position store in a shared folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F


def append_sessions(sessions: DataFrame, path: str) -> None:
    """Append finished sessions, partitioned by day so that later scans prune."""
    sessions.withColumn("day", F.to_date("finished_at")).write.mode("append").partitionBy("day").parquet(path)


class Manifest:
    """Numbered lists of data folders; a new list takes the next number or fails.

    A list is written under a name of its own and renamed to its number, which fails if the number
    is taken: of two writers one starts again from the other's list.
    """

    TRIES = 100

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path, self._jvm = path, jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        uri = self._hadoop.Path(path).toUri()
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._hadoop.FileSystem.get(uri, conf)
        self._context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def latest(self) -> tuple[int, list[str]]:
        folder = self._hadoop.Path(self.path)
        if not self._fs.exists(folder):
            return 0, []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        number = max((int(n) for n in names if n.isdigit()), default=0)
        if not number:
            return 0, []
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/{number:012d}"))
        try:
            return number, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, number: int, folders: list[str]) -> bool:
        draft = self._hadoop.Path(f"{self.path}/_draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(folders).encode()))
        stream.close()
        try:
            self._context.rename(draft, self._hadoop.Path(f"{self.path}/{number:012d}"), self._no_options)
            return True
        except Py4JJavaError as failed:
            if "FileAlreadyExistsException" not in failed.java_exception.getClass().getName():
                raise
            self._fs.delete(draft, False)
            return False

    def commit(self, change: Callable[[list[str]], list[str] | None]) -> bool:
        """Publish ``change`` of the latest list; None gives up. True if it is published."""
        for _ in range(self.TRIES):
            number, folders = self.latest()
            after = change(folders)
            if after is None:
                return False
            if self._publish(number + 1, after):
                return True
        raise RuntimeError(f"{self.path}: no free number in {self.TRIES} tries")


class PositionStore:
    """Latest word position per key, for any number of writers.

    A save or clear writes a folder of rows and adds it to the manifest. Compaction writes the latest
    row of each key of the folders it has read and replaces just these folders, so what others saved
    meanwhile stays; of two compactions of the same folders the later gives up. Readers merge the
    folders of one list, at most ``MOST`` and those saved while a compaction runs.
    """

    MOST = 16
    SCHEMA = "user_id bigint, doc_id bigint, word_idx int, ts timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, f"{self.path}/manifest")

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/rows/{name}")
        return name

    def _append(self, rows: DataFrame) -> None:
        name = self._write(rows)
        self.manifest.commit(lambda folders: [*folders, name])
        if len(self.manifest.latest()[1]) > self.MOST:
            self.compact()

    def save(self, positions: DataFrame) -> None:
        """Rows: user_id, doc_id, word_idx, ts."""
        self._append(positions.select("user_id", "doc_id", "word_idx", "ts"))

    def clear(self, keys: DataFrame) -> None:
        """Rows: user_id, doc_id, ts."""
        self._append(keys.select("user_id", "doc_id", F.lit(None).cast("int").alias("word_idx"), "ts"))

    def _latest(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.parquet(*[f"{self.path}/rows/{n}" for n in folders])
        # A clear wins over a save of the same time.
        return rows.groupBy("user_id", "doc_id").agg(
            F.max(F.struct("ts", F.col("word_idx").isNull().alias("gone"), "word_idx")).alias("m")
        ).select("user_id", "doc_id", "m.word_idx", "m.ts")

    def current(self) -> DataFrame:
        return self._latest(self.manifest.latest()[1]).where(F.col("word_idx").isNotNull())

    def compact(self) -> bool:
        """Keep the latest row per key; clears stay, so that an older save arriving later loses."""
        read = self.manifest.latest()[1]
        if not read:
            return False
        name = self._write(self._latest(read))

        def replace(folders: list[str]) -> list[str] | None:
            if not set(read) <= set(folders):
                return None
            return [name, *[f for f in folders if f not in read]]

        return self.manifest.commit(replace)

    def clear_all(self) -> None:
        """Forget everything saved up to now."""
        self.manifest.commit(lambda folders: [])
