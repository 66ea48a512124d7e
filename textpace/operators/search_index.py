"""An index for searching many strings in many documents.

``find_words`` tests a short typed list against every word. For a table of queries the words are
indexed once, in two Parquet tables of one folder:

* ``postings``: (bucket, word, key, positions): where each word stands in each document. A word's
  bucket is its hash. Rows are rebalanced by bucket as they are written, so a bucket that a word of
  every document swells is split over several tasks and files; within a file rows are ordered, so
  row groups know which words they hold. Positions ascend and the file format stores their differences.
* ``grams``: (bucket, gram, word): the words that hold each string of one to three characters,
  in lower case. It grows with the vocabulary, not with the text.

A query of three or more characters looks up its different three-character strings, keeps the words
that hold all of them and tests those; a shorter query is itself such a string. Only buckets that the
queries need are read. The plan does not depend on how many queries there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textpace.functions import words as W
from textpace.operators.ordered import by_key
from textpace.session import guard

GRAM = 3
# Partitions of each table; also the most bucket numbers that ever go through the driver.
BUCKETS = 64


def _bucket(value: str) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


def _grams(text: Column, n: int) -> Column:
    """The different strings of n characters in a text of n or more characters."""
    starts = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def _all_grams(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(F.length(text) >= n, _grams(text, n)).otherwise(none) for n in range(1, GRAM + 1)])


def _needed_grams(text: Column) -> Column:
    return F.when(F.length(text) >= GRAM, _grams(text, GRAM)).otherwise(F.array(text))


class WordIndex:
    """The index of a folder; ``key`` names the documents."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def add(self, docs: DataFrame) -> "WordIndex":
        """Index documents (key, text) that are not in the index yet.

        Postings are complete before the vocabulary that leads to them: a job that dies between the two
        leaves words that nothing finds yet, and ``vocabulary`` below adds what is missing.
        """
        guard(self.spark)
        placed = by_key(docs.select(self.key, "text"), self.key)
        tokens = placed.select(self.key, F.posexplode(W.words(F.col("text"))).alias("word_idx", "word"))
        postings = tokens.groupBy(self.key, "word").agg(F.sort_array(F.collect_list("word_idx")).alias("positions"))
        order = ("bucket", "word", self.key)
        postings.withColumn("bucket", _bucket("word")).hint("rebalance", "bucket").sortWithinPartitions(*order) \
            .write.mode("append").option("parquet.writer.version", "PARQUET_2_0").partitionBy("bucket") \
            .parquet(f"{self.path}/postings")
        self._add_vocabulary()
        return self

    def _add_vocabulary(self) -> None:
        words = self._postings().select("word").distinct()
        if self._has_grams():
            # Every word has a first character, so that gram alone lists the vocabulary once.
            known = self._grams().where(F.col("gram") == F.lower(F.substring("word", 1, 1))).select("word")
            words = words.join(known, "word", "left_anti")
        pairs = words.select("word", F.explode(_all_grams(F.lower("word"))).alias("gram"))
        order = ("bucket", "gram", "word")
        pairs.withColumn("bucket", _bucket("gram")).hint("rebalance", "bucket").sortWithinPartitions(*order) \
            .write.mode("append").partitionBy("bucket").parquet(f"{self.path}/grams")

    def _postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def _grams(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/grams")

    def _has_grams(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/grams")
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    @staticmethod
    def _only(table: DataFrame, wanted: DataFrame) -> DataFrame:
        """The buckets of a table that ``wanted`` needs: at most ``BUCKETS`` numbers."""
        needed = sorted(r[0] for r in wanted.select("bucket").distinct().collect())
        return table.where(F.col("bucket").isin(needed))

    def words(self, queries: DataFrame) -> DataFrame:
        """Words that contain a query, ignoring case: query_id, word, bucket (of the word)."""
        asked = queries.select("query_id", F.lower("text").alias("q")).where("q <> ''").distinct()
        grams = asked.withColumn("need", _needed_grams(F.col("q"))).select(
            "query_id", "q", F.size("need").alias("n"), F.explode("need").alias("gram")).withColumn("bucket", _bucket("gram"))
        # The vocabulary may have been added in parts that overlap: a word counts once for a gram.
        found = self._only(self._grams(), grams).join(grams, ["bucket", "gram"]).distinct()
        return found.groupBy("query_id", "q", "n", "word").agg(F.count("*").alias("held")).where(
            (F.col("held") == F.col("n")) & F.contains(F.lower("word"), F.col("q"))).select(
            "query_id", "word", _bucket("word").alias("bucket"))

    def find(self, queries: DataFrame) -> DataFrame:
        """Every hit of the queries (query_id, text): key, query_id, word_idx, word."""
        words = self.words(queries)
        rows = self._only(self._postings(), words).join(words, ["bucket", "word"])
        return rows.select(self.key, "query_id", F.explode("positions").alias("word_idx"), "word")

    def totals(self, queries: DataFrame) -> DataFrame:
        """Hits of each query in each document that has any: key, query_id, n. Positions are counted, not read out."""
        words = self.words(queries)
        rows = self._only(self._postings(), words).join(words, ["bucket", "word"])
        return rows.groupBy(self.key, "query_id").agg(F.sum(F.size("positions")).cast("int").alias("n"))
