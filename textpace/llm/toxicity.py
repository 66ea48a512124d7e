"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary text, are learned from labelled rows. A model knows in
how many contexts (words before it) a word stands within its class, takes a discount off each
of these counts, and gives what it took to counts of the contexts in both classes together;
these shared counts fall back to a word never seen. A rare expression, whose count is within
the discount, so costs the same in both models up to a constant. A toxic text is taken to be
ordinary but for a small part of its words, so its model is ordinary and toxic counts mixed.
A text's evidence is the difference of the two log-likelihoods divided by its number of words;
a logistic curve turns it into a score. Curve and discount are chosen on the labelled rows,
each measured without the contexts that it holds itself (nor its copies, then).

Conditioning each word on the word before it as well was tried and separates worse: pairs
repeat only within copies of a text.

Words are runs of letters in lower case. At most about ``SAMPLE_BYTES`` of text of each class
are learned from, chosen by a hash of the document's id; all texts are scored.

Rules for odd input: rows with null id, text or label teach nothing; repeated documents count once
in contexts and each time in the curve, repeated labels once; null and wordless text has no evidence and scores
as the curve at zero; with one class or none every text scores alike, 1 if all labels are 1,
else 0; an input column with the name of an output column is replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from textpace.llm.common import chunks, staged, without

# Text of each class that is learned from; the model's size follows from it.
SAMPLE_BYTES = 16 << 20
# Discounts to choose from, taken off a word's count in its class.
DISCOUNTS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
# Discount of the shared counts.
SHARED = 0.75
# Part of the words of a toxic text that its own counts speak for.
PART = 0.005
# Strength of the pull of the curve's slope to zero.
RIDGE = 1e-3
# From this score on a text is called toxic.
TOXIC = 0.7

# An odd factor for the digits of a word's hash.
_BASE = 0x9E3779B97F4A7C15
_START = np.uint64(1)


@dataclass(frozen=True)
class Model:
    words: np.ndarray      # sorted hashes
    spread: np.ndarray     # words x (ordinary, toxic, shared): contexts the word stands in
    discount: float
    slope: float
    offset: float


def _letters() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[128:] = np.arange(128, 256)
    for c in range(26):
        table[65 + c] = table[97 + c] = 97 + c
    return table


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    if n:
        steps[0] = 1
    return np.multiply.accumulate(steps)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, end to end, and where each row's words begin."""
    symbols = _letters()[data]
    inside = symbols > 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    begin, end = np.nonzero(first)[0], np.nonzero(last)[0]
    # A word's bytes as digits: the difference of two running sums, moved to the word's beginning.
    total = np.concatenate([[np.uint64(0)], np.cumsum(symbols.astype(np.uint64) * _powers(_BASE, len(symbols)))])
    back = _powers(pow(_BASE, -1, 1 << 64), len(symbols) + 1)
    found = _mixed((total[end + 1] - total[begin]) * back[begin])
    return found, np.searchsorted(begin, offsets)


def before(found: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The word before each word, a mark at the beginning of a row."""
    shifted = np.concatenate([[_START], found[:-1]]) if len(found) else found
    shifted[rows[:-1][rows[:-1] < len(found)]] = _START
    return shifted


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different (class, word before, word) of each piece of text."""
    for batch, data, offsets in chunks(batches):
        found, rows = words(data, offsets)
        toxic = np.repeat(np.asarray(batch.column(batch.schema.get_field_index("toxic"))), np.diff(rows))
        both = np.stack([toxic.astype(np.uint64), before(found, rows), found])
        both = np.unique(both, axis=1) if both.shape[1] else both
        yield pa.RecordBatch.from_arrays(
            [pa.array(both[0].astype(np.int32)), pa.array(both[1].view(np.int64)), pa.array(both[2].view(np.int64))],
            names=["toxic", "before", "word"])


def look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows of ``values`` at the wanted keys; zeros for keys that are not held."""
    if not len(keys):
        return np.zeros((len(wanted), values.shape[1]), np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return values[at] * (keys[at] == wanted)[:, None]


def own_contexts(found: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """In how many contexts each word stands within its own row."""
    row = np.repeat(np.arange(len(rows) - 1, dtype=np.uint64), np.diff(rows))
    here = _mixed(row * np.uint64(0x94D049BB133111EB) + found)
    pair = _mixed(before(found, rows) * np.uint64(0xD6E8FEB86659FD93) + here)
    _, first = np.unique(pair, return_index=True)
    kind, where = np.unique(here, return_inverse=True)
    return np.bincount(where[first], minlength=len(kind))[where]


def evidence(model: Model, data: np.ndarray, offsets: np.ndarray, discounts: tuple[float, ...],
             label: np.ndarray | None = None) -> np.ndarray:
    """Rows x discounts: toxic less ordinary log-likelihood, a word; given labels, without the row's own counts."""
    found, rows = words(data, offsets)
    spread = look(model.words, model.spread, found)
    if label is not None:
        own, label = own_contexts(found, rows), np.repeat(label, np.diff(rows))
        for k, mine in ((0, label == 0), (1, label == 1), (2, True)):
            spread[:, k] = np.maximum(spread[:, k] - np.where(mine, own, 0), 0)
    sums = np.maximum(model.spread.sum(0, dtype=np.float64), 1)
    kinds = int((model.spread[:, 2] > 0).sum())
    shared = np.maximum(spread[:, 2] - SHARED, 0) / sums[2] + max(SHARED * kinds / sums[2], 1e-9) / (kinds + 1)
    out = []
    for discount in discounts:
        taken = np.minimum(model.spread[:, :2], discount).sum(0, dtype=np.float64) / sums[:2]
        ordinary, toxic = (
            np.maximum(spread[:, k] - discount, 0) / sums[k] + (taken[k] or 1.0) * shared for k in (0, 1))
        out.append(per_row_sum(np.log(1 - PART + PART * toxic / ordinary), rows) / np.maximum(np.diff(rows), 1))
    return np.stack(out, 1)


def per_row_sum(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[rows[1:]] - total[rows[:-1]]


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Slope and offset of the logistic curve, by Newton's method on the scaled evidence, and its mean loss."""
    scale = max(float(np.sqrt(np.average(x * x, weights=weight))), 1e-9)
    cols, beta = np.stack([x / scale, np.ones(len(x))], 1), np.zeros(2)
    # One row of each class, a little apart, keeps the curve finite and rising.
    cols = np.concatenate([cols, [[1.0, 1.0], [-1.0, 1.0]]])
    y, weight = np.append(y, [1.0, 0.0]), np.append(weight / weight.sum() * len(x), [0.5, 0.5])
    pull = np.array([RIDGE, 1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(cols @ beta, -500, 500)))
        step = np.linalg.solve((cols * (weight * p * (1 - p))[:, None]).T @ cols + np.diag(pull),
                               cols.T @ (weight * (y - p)) - pull * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    loss = np.average(np.logaddexp(0, -(2 * y - 1) * (cols @ beta)), weights=weight)
    return float(max(beta[0], 0.0) / scale), float(beta[1]), float(loss)


def fit(docs: DataFrame, labels: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from the texts of documents (doc_id, text) with labels (doc_id, toxic 0 or 1).

    Sizes and labels choose the documents to learn from; only then are texts read, so that no text
    goes through an exchange but the chosen ones.
    """
    texts = docs.where("text is not null").select("doc_id", "text")
    marks = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    marked = staged(texts.select("doc_id", F.octet_length("text").alias("bytes")).join(marks, "doc_id"), "marked")
    size = {r["toxic"]: (r["b"], r["n"]) for r in marked.groupBy("toxic").agg(
        F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()}
    n = {t: size.get(t, (0, 0))[1] for t in (0, 1)}
    if not (n[0] and n[1]):
        return Model(np.zeros(0, np.uint64), np.zeros((0, 3), np.float32), DISCOUNTS[0], 0.0, np.inf if n[1] else -np.inf)
    rate = {t: min(1.0, sample_bytes / max(b, 1)) for t, (b, _) in size.items()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    drawn = staged(marked.where(part < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))
                   .select("doc_id", "toxic").distinct(), "drawn")
    chosen = staged(texts.join(drawn, "doc_id").select(F.lower("text").alias("text"), "toxic"), "labelled")
    contexts = chosen.select("text", "toxic").mapInArrow(
        _contexts, "toxic int, before bigint, word bigint").groupBy("before", "word").agg(
        F.max((F.col("toxic") == 0).cast("int")).alias("c0"), F.max((F.col("toxic") == 1).cast("int")).alias("c1"))
    table = contexts.groupBy("word").agg(
        F.sum("c0").alias("s0"), F.sum("c1").alias("s1"), F.count("*").alias("s2")).toPandas()
    keys = table["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    model = Model(keys[order], table[["s0", "s1", "s2"]].to_numpy(np.float32)[order], DISCOUNTS[0], 0.0, 0.0)

    def measure(batches):
        for batch, data, offsets in chunks(batches):
            toxic = np.asarray(batch.column(batch.schema.get_field_index("toxic")))
            x = evidence(model, data, offsets, DISCOUNTS, toxic)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(toxic)], names=["x", "toxic"])

    seen = chosen.select("text", "toxic").mapInArrow(measure, "x array<double>, toxic int").toPandas()
    y = seen["toxic"].to_numpy(float)
    if not len(y):
        return replace(model, offset=float(np.log(n[1] / n[0])))
    x, weight = np.stack(seen["x"].to_numpy()), np.where(y == 1, 1 / rate[1], 1 / rate[0])
    fits = [curve(x[:, i], y, weight) for i in range(len(DISCOUNTS))]
    best = min(range(len(fits)), key=lambda i: fits[i][2])
    return replace(model, discount=DISCOUNTS[best], slope=fits[best][0], offset=fits[best][1])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Add score (0 to 1) and predicted (0 or 1) to every row."""
    df = without(docs, "score", "predicted", "_lower")
    schema = StructType(df.schema.fields[:]).add("score", DoubleType())

    def run(batches):
        for batch, data, offsets in chunks(batches, "_lower"):
            x = evidence(model, data, offsets, (model.discount,))[:, 0]
            with np.errstate(over="ignore"):
                score = 1 / (1 + np.exp(-(model.slope * x + model.offset)))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], names=schema.fieldNames())

    scored = df.select("*", F.lower("text").alias("_lower")).mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))
