"""The word index against a plain search."""

import random

from pyspark.sql import functions as F

from textpace.functions import words as W
from textpace.operators import search as S
from textpace.operators.search_index import WordIndex

TEXTS = [(1, "The other tHEme, and aAa ÉON éon"), (2, None), (3, ""), (4, "the the the 12.5% it's"), (None, "bathe a"), (5, "x " * 500 + "the")]
QUERIES = [(1, "THE"), (2, "a"), (3, "éon"), (4, ""), (5, None), (6, "aaa"), (7, "the other"), (8, "zz"), (9, "THE"), (10, "5%"), (11, "x")]


def frames(spark):
    return (spark.createDataFrame(TEXTS, "doc_id INT, text STRING"),
            spark.createDataFrame(QUERIES, "query_id INT, text STRING"))


def plain(docs, queries):
    words = docs.select("doc_id", F.posexplode(W.words(F.col("text"))).alias("word_idx", "word")).collect()
    return sorted(((r.doc_id, q, r.word_idx, r.word) for r in words for q, t in queries if t and t.lower() in r.word.lower()), key=str)


def hits(df):
    return sorted(((r.doc_id, r.query_id, r.word_idx, r.word) for r in df.collect()), key=str)


def test_index_equals_plain_search(spark, tmp_path):
    docs, queries = frames(spark)
    index = WordIndex(spark, str(tmp_path / "i")).add(docs)
    want = plain(docs, QUERIES)
    assert hits(index.find(queries)) == want
    counts = {}
    for doc, q, _, _ in want:
        counts[doc, q] = counts.get((doc, q), 0) + 1
    assert {(r.doc_id, r.query_id): r.n for r in index.totals(queries).collect()} == counts
    assert hits(index.find(queries.where("query_id in (4, 5)"))) == []


def test_documents_may_come_later(spark, tmp_path):
    docs, queries = frames(spark)
    more = spark.createDataFrame([(9, "breathe the new aaaa")], "doc_id INT, text STRING")
    index = WordIndex(spark, str(tmp_path / "i")).add(docs).add(more)
    assert hits(index.find(queries)) == plain(docs.union(more), QUERIES)
    # A job that died after the postings: the next one completes the vocabulary.
    index._add_vocabulary()
    assert hits(index.find(queries)) == plain(docs.union(more), QUERIES)


def test_index_equals_literal_search_on_random_words(spark, tmp_path):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join("".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(40))) for i in range(30)],
                                 "doc_id INT, text STRING")
    texts = ["a", "bb", "abc", "abca", "cccc", "ba"]
    got = WordIndex(spark, str(tmp_path / "i")).add(docs).find(spark.createDataFrame(list(enumerate(texts)), "query_id INT, text STRING"))
    assert hits(got) == hits(S.find_words(docs, texts))


def test_only_needed_buckets_and_one_plan_for_any_number_of_queries(spark, tmp_path):
    docs, _ = frames(spark)
    index = WordIndex(spark, str(tmp_path / "i")).add(docs)
    sizes = []
    for n in (1, 200):
        queries = spark.createDataFrame([(i, "the") for i in range(n)], "query_id INT, text STRING")
        found = index.find(queries)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(plan.splitlines()))
        words = index.words(queries).select("word", "bucket").distinct().collect()
        read = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in read and len({r.bucket for r in words}) < 16
        assert found.count() == n * len(plain(docs, [(0, "the")]))
    assert sizes[0] == sizes[1]
