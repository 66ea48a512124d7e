"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1. One binary n-gram classifier per bit, a linear
log-odds weighting of hashed byte bigrams and trigrams, tells the two sides of the bit
apart. A text's language is the codeword with the least loss, each bit weighted by how
well it separates the languages; a narrow lead over the second codeword is ambiguous.

Rules for odd input: rows with null text or language teach nothing; null text and text
without a letter are predicted ``und`` with score 0; with no learned language every text
is ``und``; repeated rows count each time; an input column with the name of an output
column is replaced; all other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from textpace.llm.common import chunks, without

# Hashed features of each n-gram order.
TABLE = 1 << 13
ORDERS = (2, 3)
FEATURES = TABLE * len(ORDERS)
# Weight of one n-gram in a text of one.
WEIGHT = 1000
# Part of each language's rates that is taken from the average of all languages.
SHARED = 0.1
# The per-language counts are held by the driver; more languages are refused.
MAX_LANGUAGES = 256
# Up to this many languages every two-sided split is a bit; beyond, random splits are drawn.
EXHAUSTIVE = 6
# Lead in weighted loss under which a prediction is called ambiguous.
NARROW = 0.01
UNKNOWN = "und"
ROWS_AT_ONCE = 64


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray      # languages x bits, +1 or -1
    weights: np.ndarray   # features x bits
    trust: np.ndarray     # per bit, sums to 1
    scale: float


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """Codewords of n languages, far from each other, with no constant or repeated bit."""
    if n < 2:
        return np.ones((n, 0))
    if n <= EXHAUSTIVE:
        columns = [[1.0 if b >> i & 1 else -1.0 for i in range(n)] for b in range(1, 1 << n, 2)]
        return np.array([c for c in columns if min(c) < 0]).T
    bits, rng, best, least = int(np.ceil(12 * np.log2(n))), np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = np.where(rng.random((n, bits)) < 0.5, -1.0, 1.0)
        apart = ((bits - code @ code.T) / 2 + np.eye(n) * bits).min()
        if apart > least and (np.abs(code.sum(0)) < n).all():
            best, least = code, apart
    return best


def _letters() -> np.ndarray:
    table = np.full(256, 32, np.uint32)
    table[128:] = np.arange(128, 256)
    for c in range(26):
        table[65 + c] = table[97 + c] = 97 + c
    return table


LETTERS = _letters()


def counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of each row's letters, others being one space each: row, feature and number of those there are, in order."""
    n, symbols = len(offsets) - 1, LETTERS.take(data)
    row = np.repeat(np.arange(n, dtype=np.uint32) * np.uint32(FEATURES), np.diff(offsets))
    keys, gram = [], symbols
    for i, order in enumerate(ORDERS):
        for j in range(1 if i == 0 else ORDERS[i - 1], order):
            gram = gram[:-1] * np.uint32(257) + symbols[j:]
        # Cells are bits of the product that 32-bit arithmetic keeps.
        cell = (gram * np.uint32(0x9E3779B1) >> np.uint32(12)) & np.uint32(TABLE - 1)
        key = row[:len(gram)] + (cell + np.uint32(i * TABLE))
        # What would go on in the next row is put behind all rows.
        across = (offsets[1:, None] - np.arange(1, order)).ravel()
        key[across[(across >= 0) & (across < len(key))]] = n * FEATURES
        keys.append(key)
    found = np.sort(np.concatenate(keys))
    found = found[:np.searchsorted(found, np.uint32(n * FEATURES))]
    first = np.flatnonzero(np.concatenate([found[:1] >= 0, found[1:] != found[:-1]]))
    key = found[first]
    row = key // np.uint32(FEATURES)
    return row.astype(np.int64), (key - row * np.uint32(FEATURES)).astype(np.int64), np.diff(first, append=len(found))


def _tally(batches):
    """Per task: n-gram counts of each language."""
    sums: dict[str, np.ndarray] = {}
    for batch, data, offsets in chunks(batches):
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        for at in range(0, len(langs), ROWS_AT_ONCE):
            to = min(at + ROWS_AT_ONCE, len(langs))
            row, feature, found = counts(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
            # A text weighs as the square root of its length, so that no long text speaks for a language.
            size = np.bincount(row, weights=found, minlength=to - at)
            found = np.rint(found * (WEIGHT / np.sqrt(np.maximum(size, 1)))[row])
            known, lang = np.unique(langs[at:to], return_inverse=True)
            added = np.bincount(lang[row] * FEATURES + feature, weights=found, minlength=len(known) * FEATURES)
            for name, n in zip(known.tolist(), added.reshape(-1, FEATURES).astype(np.int64)):
                sums[name] = sums[name] + n if name in sums else n
    for lang, n in sums.items():
        used = np.nonzero(n)[0]
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * len(used)), "feature": pa.array(used.astype(np.int32)),
            "n": pa.array(n[used].astype(np.int64))})


def fit(labelled: DataFrame) -> Model:
    """Learn from all rows of ``labelled`` (text, lang)."""
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")

    def few(df: DataFrame) -> bool:
        return df.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() <= MAX_LANGUAGES

    # Texts are looked at only where all languages, with those of rows without text, are too many.
    if not few(labelled) and not few(rows):
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    cells = rows.mapInArrow(_tally, "lang string, feature int, n long") \
        .groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(cells["lang"]))
    table = np.zeros((len(languages), FEATURES))
    table[[languages.index(x) for x in cells["lang"]], cells["feature"]] = cells["n"]
    return learn(languages, table)


def learn(languages: list[str], table: np.ndarray) -> Model:
    """Bit classifiers from the languages x features counts; languages weigh the same."""
    code = codewords(len(languages))
    rate = table / np.maximum(table.sum(1, keepdims=True), 1)
    rate = (1 - SHARED) * rate + SHARED * (rate.mean(0) if len(rate) else 0) + 1e-12
    weights = np.zeros((FEATURES, code.shape[1]))
    for b in range(code.shape[1]):
        weights[:, b] = np.log(rate[code[:, b] > 0].mean(0)) - np.log(rate[code[:, b] < 0].mean(0))
    # How far the typical text of each language lies on its right side of the bit.
    lead = (code * (rate @ weights)).min(0) if code.shape[1] else np.zeros(0)
    trust = np.maximum(lead, 1e-3)
    scale = 6 / max(float(np.abs(rate @ weights).mean()), 1e-3) if code.shape[1] else 1.0
    return Model(languages, code, weights, trust / trust.sum() if len(trust) else trust, scale)


def decode(model: Model, data: np.ndarray, offsets: np.ndarray):
    """Best codeword, its share of the evidence and its lead over the second, per row."""
    best, share, lead = [], [], []
    weights = np.ascontiguousarray(model.weights.T)
    for at in range(0, len(offsets) - 1, ROWS_AT_ONCE):
        to = min(at + ROWS_AT_ONCE, len(offsets) - 1)
        row, feature, found = counts(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
        first = np.flatnonzero(np.diff(row, prepend=-1))
        margin = np.zeros((to - at, len(weights)))
        if len(first):
            found = found.astype(float)
            size = np.add.reduceat(found, first)
            for bit, w in enumerate(weights):
                margin[row[first], bit] = np.add.reduceat(found * w[feature], first) / size * model.scale
        loss = np.stack([(np.logaddexp(0, -margin * word) * model.trust).sum(1) for word in model.code], axis=1)
        ranked = np.sort(loss, axis=1)
        evidence = np.exp(-4 * (loss - ranked[:, :1]))
        best.append(loss.argmin(1))
        share.append(1 / evidence.sum(1))
        lead.append(ranked[:, 1] - ranked[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf))
    return np.concatenate(best), np.concatenate(share), np.concatenate(lead)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred, score (0 to 1) and ambiguous to every row."""
    df = without(docs, "lang_pred", "score", "ambiguous", "_judged")
    lettered = F.when(F.col("text").rlike(r"\p{L}"), F.lower("text"))
    schema = StructType().add("lang_pred", StringType()).add("score", DoubleType()).add("ambiguous", BooleanType())

    @F.arrow_udf(schema)
    def judge(text: pa.Array) -> pa.Array:
        parts = [_judged(model, data, offsets) for _, data, offsets in chunks([pa.record_batch([text], ["text"])])]
        names, score, close = (np.concatenate(x) for x in zip(*parts)) if parts else ([], [], [])
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], schema.fieldNames())

    # Only the text goes to Python, and only the judgement comes back. Called not deterministic, it
    # is not worked out a second time where a caller filters by it.
    judged = df.withColumn("_judged", judge.asNondeterministic()(lettered))
    return judged.withColumns({n: F.col("_judged")[n] for n in schema.fieldNames()}).drop("_judged")


def _judged(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text; an empty one has no letter."""
    known, n = np.diff(offsets) > 0, len(offsets) - 1
    if not model.languages:
        return np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
    best, share, lead = decode(model, data, offsets)
    return (np.where(known, np.array(model.languages, object)[best], UNKNOWN), np.where(known, share, 0.0),
            ~known | (lead < NARROW))
