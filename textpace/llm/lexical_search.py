"""Ranked lexical search: hybrid term-at-a-time and document-at-a-time.

The documents are indexed in blocks. A block holds, for every term that a query uses, the
list of its documents and counts, with the terms of each document. Document counts of terms
and the collection's size come from all blocks, so weights are those of the collection.

Each block then answers every query. The query's short lists are summed first, term at a
time, into one accumulator list. That list and the long lists are read document at a time,
in windows of documents: each list has a greatest score, and lists whose greatest scores
together stay below the score of the last kept document bring no candidates of their own;
they are only looked up at the candidates of the other lists, and only while these can
still be kept. A task keeps the best documents of each query over all its blocks.

Queries are taken in blocks of about ``QUERY_BYTES``, one pass over the documents each, so
no task or driver holds more than one block of them, whatever their number.

Rules for odd input: null text has no term; a document or query without terms is in no
ranking; repeated rows of documents are ranked each, equal scores by document id, null last;
repeated rows of queries are answered each; with no documents or queries the result is
empty; only ``item_id``, ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from textpace.llm.common import chunks, staged
from textpace.session import shared_dir

TOP = 10
# Text of the queries that one pass over the documents answers.
QUERY_BYTES = 4 << 20
# Text of the documents that one block of the index holds, unless one document is longer.
BLOCK_BYTES = 4 << 20
# A query's shortest lists are summed first, up to this many postings of a block.
SHORT = 256
# Documents of one window of the document-at-a-time step.
WINDOW = 512
# Candidates of one query are ranked in this many groups before the groups are ranked together.
GROUPS = 64

# Every ASCII character that is no letter or digit separates; A-Z are lower-cased.
TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

INDEX = ("docs array<bigint>, sizes array<bigint>, terms array<int>, places array<int>, counts array<int>, "
         "n_docs bigint, n_terms bigint")


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text."""
    return text.translate(TERM_BYTES).split()


def _index(vocabulary: dict[bytes, int], limit: int) -> Callable:
    """Blocks of documents to one row each: postings by term, then by place in ``docs``."""
    width = max(len(vocabulary), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = vocabulary.get
        for batch, data, offsets in chunks(batches, limit=limit):
            raw, sizes, cells, kept = data.tobytes(), [], [], []
            n_docs = n_terms = 0
            for row in range(batch.num_rows):
                words = terms(raw[offsets[row]:offsets[row + 1]])
                if not words:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(words)
                known = [t for t in map(find, words) if t is not None]
                if known:
                    cells.append(np.array(known, np.int64) * batch.num_rows + len(kept))
                    kept.append(row)
                    sizes.append(len(words))
            cell, count = np.unique(np.concatenate(cells), return_counts=True) if cells else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_pydict({
                "docs": pa.array([batch.column(0).take(pa.array(kept, pa.int64())).to_pylist()], pa.list_(pa.int64())),
                "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "terms": pa.array([cell // batch.num_rows], pa.list_(pa.int32())),
                "places": pa.array([cell % batch.num_rows], pa.list_(pa.int32())),
                "counts": pa.array([count], pa.list_(pa.int32())),
                "n_docs": pa.array([n_docs], pa.int64()), "n_terms": pa.array([n_terms], pa.int64())})

    return run


def _lengths(width: int) -> Callable:
    """Documents of each term, and documents and terms in all (as terms -1 and -2), per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = np.zeros(width, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=width)
            sums += [sum(batch.column("n_docs").to_pylist()), sum(batch.column("n_terms").to_pylist())]
        used = np.nonzero(held)[0]
        yield pa.RecordBatch.from_pydict({
            "term": pa.array(np.concatenate([[-1, -2], used]).astype(np.int32)),
            "n": pa.array(np.concatenate([sums, held[used]]))})

    return run


def impacts(weight: np.ndarray, tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence count adds to a score, in whole numbers."""
    longer = 10 + 90 * size * n_docs // max(n_terms, 1)
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * longer))


class Best:
    """The best documents of one query so far."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(p) for p in ((self.score, score), (self.doc, doc), (self.null, null)))
        first = np.lexsort((doc, null, -score))[:self.k]
        self.score, self.doc, self.null = score[first], doc[first], null[first]
        if len(first) == self.k:
            self.floor = int(self.score[-1])


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: the sum of short lists, as one list."""
    place, where = np.unique(np.concatenate([p for p, _ in lists]), return_inverse=True)
    total = np.zeros(len(place), np.int64)
    np.add.at(total, where, np.concatenate([s for _, s in lists]))
    return place, total


def by_document(lists: list[tuple[np.ndarray, np.ndarray]], n: int, best: Best, doc: np.ndarray, null: np.ndarray,
                window: int = WINDOW) -> None:
    """Document at a time over lists (places, scores), skipping what cannot be kept."""
    lists = sorted(lists, key=lambda one: -int(one[1].max()))
    # rest[i]: the most that lists i and later can add.
    rest = np.append(np.cumsum([int(s.max()) for _, s in lists[::-1]], dtype=np.int64)[::-1], 0)
    at = 0
    while at < n and rest[0] >= best.floor:
        leading = int(np.searchsorted(-rest, -best.floor, side="right"))  # lists from here on bring no candidates
        # The next place that a leading list holds.
        begins = [int(np.searchsorted(p, at)) for p, _ in lists[:leading]]
        heads = [int(p[b]) for (p, _), b in zip(lists, begins) if b < len(p)]
        if not heads:
            return
        at = min(heads)
        total, seen = np.zeros(window, np.int64), np.zeros(window, bool)
        for (place, score), b in zip(lists, begins):
            e = int(np.searchsorted(place, at + window))
            total[place[b:e] - at] += score[b:e]
            seen[place[b:e] - at] = True
        here = np.nonzero(seen)[0]
        score = total[here]
        for i in range(leading, len(lists)):
            alive = score + rest[i] >= best.floor
            here, score = here[alive], score[alive]
            if not len(here):
                break
            place, more = lists[i]
            found = np.searchsorted(place, here + at)
            hit = np.minimum(found, len(place) - 1)
            score = score + np.where(place[hit] == here + at, more[hit], 0)
        alive = score >= best.floor
        if alive.any():
            best.add(score[alive], doc[here[alive] + at], null[here[alive] + at])
        at += window


def _search(wanted: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int, short: int, window: int):
    """Blocks of the index to the best documents of every query over all blocks of the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests = [Best(k) for _ in wanted]
        for batch in batches:
            for row in range(batch.num_rows):
                docs, sizes, term, place, tf = (batch.column(i)[row].values for i in range(5))
                null = docs.is_null().to_numpy(zero_copy_only=False)
                doc = docs.fill_null(0).to_numpy()
                term, place, tf = term.to_numpy(), place.to_numpy(), tf.to_numpy().astype(np.int64)
                score = impacts(weight[term], tf, sizes.to_numpy()[place], n_docs, n_terms)
                begin = np.searchsorted(term, np.arange(len(weight) + 1))
                for query, best in zip(wanted, bests):
                    spans = sorted((int(begin[t + 1] - begin[t]), int(begin[t])) for t in query)
                    lists, held, few = [], 0, []
                    for n, b in spans:
                        if not n:
                            continue
                        one = (place[b:b + n], score[b:b + n])
                        held += n
                        (few if held <= short else lists).append(one)
                    if few:
                        lists.append(accumulate(few))
                    if lists:
                        by_document(lists, len(doc), best, doc, null, window)
        for i, best in enumerate(bests):
            if len(best.score):
                yield pa.RecordBatch.from_pydict({
                    "_query": pa.array(np.full(len(best.score), i, np.int32)),
                    "doc_id": pa.array(best.doc, pa.int64(), mask=best.null), "score": pa.array(best.score)})

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, first within groups of tasks, then over the groups."""
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    group = F.spark_partition_id() % GROUPS
    part = Window.partitionBy("_query", "_group").orderBy(*order)
    whole = Window.partitionBy("_query").orderBy(*order)
    few = found.withColumn("_group", group).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).drop("_group")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, query_bytes: int = QUERY_BYTES,
           block_bytes: int = BLOCK_BYTES, short: int = SHORT, window: int = WINDOW) -> DataFrame:
    """The k best documents (doc_id, text) for each item (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    queries = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(-(-size // query_bytes), 1)))
    # A long query makes parts that stay empty.
    parts = sorted(r[0] for r in queries.select(part_of).distinct().collect()) or [0]
    out = shared_dir(spark, "ranking")
    for part in parts:
        asked = queries.where(part_of == part).collect()
        split = [sorted(set(terms(r["text"].encode()))) for r in asked]
        vocabulary = {t: i for i, t in enumerate(sorted({t for one in split for t in one}))}
        wanted = [np.array([vocabulary[t] for t in one], np.int64) for one in split]
        index = staged(texts.mapInArrow(_index(vocabulary, block_bytes), INDEX), "index")
        held = dict(index.select("terms", "n_docs", "n_terms").mapInArrow(_lengths(len(vocabulary)), "term int, n bigint")
                    .groupBy("term").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False, name=None))
        n_docs, n_terms = int(held.get(-1, 0)), int(held.get(-2, 0))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(t, 0) + 1)))
                           for t in range(len(vocabulary))], np.int64)
        found = index.drop("n_docs", "n_terms").mapInArrow(
            _search(wanted, weight, n_docs, n_terms, k, short, window), "_query int, doc_id bigint, score bigint")
        names = spark.createDataFrame(
            [(i, r["item_id"]) for i, r in enumerate(asked)],
            StructType([StructField("_query", LongType()), StructField("item_id", items.schema["item_id"].dataType)]))
        _ranked(found, k).join(names, "_query").select("item_id", "rank", "doc_id", "score") \
            .write.mode("overwrite").parquet(f"{out}/part={part}")
    schema = StructType([
        StructField("item_id", items.schema["item_id"].dataType), StructField("rank", IntegerType()),
        StructField("doc_id", LongType()), StructField("score", LongType()), StructField("part", IntegerType())])
    return spark.read.schema(schema).parquet(out).drop("part")
