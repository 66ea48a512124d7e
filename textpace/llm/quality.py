"""Quality rules as a short-circuit cascade.

Every rule is first timed on a sample of rows, where its share of rejected rows is noted
too; rules then run by rejections per second, most first, and a row leaves the cascade at
the first rule that rejects it. The order changes the work, never the verdict.

Rules for odd input: null text is the empty text, has no words and fails the base rules;
texts of any length are read whole; repeated rows are judged alike; an empty table gives
an empty result; an input column with the name of an output column is replaced, all other
columns pass through.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from textpace.llm.common import chunks, per_row, without

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# Rows on which costs and selectivities are estimated (an expected number).
SAMPLE_ROWS = 400
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Text:
    """One document's bytes; what several rules need is worked out once."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]


@dataclass(frozen=True)
class Rule:
    """``rejects`` tells of a text whether it goes."""
    name: str
    rejects: Callable[[Text], bool]


def _share(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


def _odd_word_length(t: Text) -> bool:
    chars = sum(len(w.decode("utf-8", "replace")) for w in t.words)
    return bool(t.words) and not 2 <= chars / len(t.words) <= 20


def _shouting(t: Text) -> bool:
    s = t.raw.decode("utf-8", "replace")
    upper, lower = sum(map(str.isupper, s)), sum(map(str.islower, s))
    return upper > lower


# The rules beyond the base; all thresholds are far from ordinary prose.
RULES = (
    Rule("symbols", lambda t: sum(t.raw.count(bytes([c])) for c in SYMBOLS) > 0.5 * len(t.words)),
    Rule("repeated_lines", lambda t: _share(len(t.lines) - len(set(t.lines)), len(t.lines)) > 0.3),
    Rule("few_kinds_of_word", lambda t: len(t.words) >= 100 and len(set(t.words)) < 0.05 * len(t.words)),
    Rule("bullets", lambda t: _share(sum(x.lstrip()[:1] in (b"-", b"*") for x in t.lines), len(t.lines)) > 0.9),
    Rule("ellipses", lambda t: _share(sum(x.rstrip().endswith(b"...") for x in t.lines), len(t.lines)) > 0.3),
    Rule("word_length", _odd_word_length),
    Rule("shouting", _shouting),
)


def measure(data: np.ndarray, offsets: np.ndarray, texts: list[Text]) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    symbol = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
    return {
        "n_words": np.array([len(t.words) for t in texts], np.int64),
        "word_chars": per_row(~space & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_row(symbol, offsets),
        "n_dup_lines": np.array([len(t.lines) - len(set(t.lines)) for t in texts], np.int64),
        "n_repeat_words": repeat_words(texts),
    }


def repeat_words(texts: list[Text]) -> np.ndarray:
    """Words inside windows of eight that occur more than once in their text.

    Window hashes find the texts to look at: equal windows have equal hashes, so none is
    missed. Those texts are then settled on the words themselves.
    """
    sizes = np.array([len(t.words) for t in texts], np.int64)
    out, total = np.zeros(len(texts), np.int64), int(sizes.sum())
    if total < WINDOW:
        return out
    word = np.fromiter(map(hash, chain.from_iterable(t.words for t in texts)), np.int64, total).view(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    n = total - WINDOW + 1
    window = owner[:n].astype(np.uint64)
    for j in range(WINDOW):
        window = (window ^ word[j:n + j]) * np.uint64(0x9E3779B97F4A7C15)
        window ^= window >> np.uint64(31)
    whole = np.nonzero(owner[:n] == owner[WINDOW - 1:])[0]
    order = whole[np.argsort(window[whole])]
    twin = window[order][1:] == window[order][:-1]
    for doc in np.unique(owner[order[1:][twin]]):
        out[doc] = _repeat_words_exact(texts[doc].words)
    return out


def _repeat_words_exact(words: list[bytes]) -> int:
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    # Number the windows of 2, 4 and 8 words by pairs of the windows half as long.
    for width in (1, 2, 4):
        pair = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        _, ids = np.unique(pair, return_inverse=True)
    repeated = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:len(ids)] += repeated
    edge[WINDOW:] -= repeated
    return int((np.cumsum(edge)[:-1] > 0).sum())


def estimate(docs: DataFrame, rules=RULES, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a row, share rejected) from a sample chosen by a hash of the text."""
    total = docs.count()
    of = max(1, total // rows)
    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(of)) == 0)

    def timed(batches):
        for batch, data, offsets in chunks(batches):
            raws = [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
            for rule in rules:
                texts = [Text(r) for r in raws]
                start = time.perf_counter()
                gone = sum(rule.rejects(t) for t in texts)
                yield pa.RecordBatch.from_pydict({
                    "rule": [rule.name], "n": [len(raws)], "gone": [gone],
                    "seconds": [time.perf_counter() - start]})

    found = {r["rule"]: r for r in sample.mapInArrow(timed, "rule string, n long, gone long, seconds double")
             .groupBy("rule").agg(F.sum("n").alias("n"), F.sum("gone").alias("gone"),
                                  F.sum("seconds").alias("seconds")).collect()}
    return [(r.name, found[r.name]["seconds"] / found[r.name]["n"], found[r.name]["gone"] / found[r.name]["n"])
            if r.name in found else (r.name, 0.0, 0.0) for r in rules]


def ordered(rules, estimates: list[tuple[str, float, float]]) -> list[Rule]:
    """Rules by rejections per second, then by name."""
    worth = {name: share / max(cost, 1e-9) for name, cost, share in estimates}
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def cascade(docs: DataFrame, rules=RULES) -> DataFrame:
    """Add the base measures, base_failed, kept and failed_rule (null where kept) to every row."""
    line = ordered(rules, estimate(docs, rules))
    df = without(docs, *MEASURES, "base_failed", "kept", "failed_rule")
    schema = StructType(df.schema.fields[:])
    for name in MEASURES:
        schema = schema.add(name, LongType())
    schema = schema.add("base_failed", BooleanType()).add("kept", BooleanType()).add("failed_rule", StringType())

    def run(batches):
        for batch, data, offsets in chunks(batches):
            texts = [Text(data[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            found = measure(data, offsets, texts)
            base = (found["n_words"] < MIN_WORDS) | (
                100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])
            failed = ["base" if b else next((r.name for r in line if r.rejects(t)), None)
                      for b, t in zip(base, texts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(found[m]) for m in MEASURES], pa.array(base),
                 pa.array([f is None for f in failed]), pa.array(failed, pa.string())],
                names=schema.fieldNames())

    return df.mapInArrow(run, schema)
