"""Language-model scoring by partial matching over bytes.

A trie of byte contexts up to order three is counted over all training texts. A byte is
coded in its longest known context; a byte not seen there costs an escape and is coded one
order lower, where the bytes of the longer context are excluded. The trie is fixed once
learned, so the cost of every known four-byte string is worked out beforehand and a text
is scored by lookups; only strings that training never showed walk down the orders. Where
training shows more strings than a task may hold, the trie stays in tables: tasks hold the
costs of the most frequent strings, and all others are joined to theirs.

Beside it stands the base score, add-one unigrams of words. Counts of the most frequent
words are held by every task; the words beyond are joined.

Rules for odd input: null text is the empty text, which has its end token alone; texts of
any length are scored whole; repeated rows are scored each; with nothing to learn from all
counts are zero and bytes cost eight bits; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from textpace.llm.common import chunks, lower_ascii, staged

ORDER = 3
# Pads the start and codes the end of a text; no UTF-8 text holds this byte.
EDGE = 0xFF
ALPHABET = 256
# Strings of the trie that each task holds at most; the costs of all others are joined.
MAX_NODES = 4_000_000
# Word counts that each task holds at most; all others are joined.
MAX_HELD_WORDS = 250_000
# Distinct words that a counting task gathers before it hands them on.
FLUSH_WORDS = 400_000
END_WORD = b" "


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The four-byte strings that end at each byte and at the end of each text, and their counts per text."""
    sizes = np.diff(offsets)
    n = len(sizes)
    out = np.full(len(data) + (ORDER + 1) * n, EDGE, np.uint8)
    out[np.arange(len(data)) + np.repeat((ORDER + 1) * np.arange(n) + ORDER, sizes)] = data
    wide = out.astype(np.uint32)
    grams = np.zeros(max(len(out) - ORDER, 0), np.uint32)
    for j in range(ORDER + 1):
        grams = (grams << np.uint32(8)) | wide[j:len(grams) + j]
    ends = offsets[1:] + (ORDER + 1) * np.arange(n)
    own = np.ones(len(grams), bool)
    for j in range(1, ORDER + 1):
        cross = ends + j
        own[cross[cross < len(own)]] = False
    return grams[own], sizes + 1


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def _gather(batches):
    """Per task: counts of words (key 't' and the word) and of byte strings (key 'g' and the bytes)."""
    def batch(keys, counts):
        return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "n": pa.array(counts, pa.int64())})

    words: Counter = Counter()
    keys, counts, held = [], [], 0
    for piece, data, offsets in chunks(batches, "_low"):
        for a, b in zip(offsets, offsets[1:]):
            words.update(data[a:b].tobytes().split())
        words[END_WORD] += piece.num_rows
        if len(words) > FLUSH_WORDS:
            yield batch([b"t" + w for w in words], list(words.values()))
            words = Counter()
        found, n = np.unique(padded(data, offsets)[0], return_counts=True)
        keys.append(found)
        counts.append(n)
        held += len(found)
        if held > 2_000_000:
            merged = _merge(keys, counts)
            keys, counts, held = [merged[0]], [merged[1]], len(merged[0])
    if words:
        yield batch([b"t" + w for w in words], list(words.values()))
    if keys:
        key, n = _merge(keys, counts)
        yield batch([b"g" + int(k).to_bytes(ORDER + 1, "big") for k in key], n)


class Table:
    """A read-only hash table from integers to floats, with vector lookups."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(max(1, 4 * len(keys)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.float64)
        keys, left, self.reach = keys.astype(np.int64), np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], self.reach)
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            put = left[free][first]
            at = slot[free][first]
            self.keys[at], self.values[at] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            self.reach += 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        h = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (h.astype(np.int64) + step) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent), and which keys are present."""
        keys = keys.astype(np.int64)
        slot = self._slot(keys, 0)
        known = self.keys[slot] == keys
        out = np.where(known, self.values[slot], 0.0)
        left = np.nonzero(~known & (self.keys[slot] >= 0))[0]
        for step in range(1, self.reach):
            if not len(left):
                break
            slot = self._slot(keys[left], step)
            hit = self.keys[slot] == keys[left]
            out[left[hit]], known[left[hit]] = self.values[slot[hit]], True
            left = left[~hit & (self.keys[slot] >= 0)]
        return out, known


@dataclass
class Level:
    """Counts of one order: per (context, byte), and per context totals and kinds of byte."""
    pairs: np.ndarray
    count: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    shorter: np.ndarray    # sum of the one-order-shorter counts of the context's bytes


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the wanted values in sorted keys, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def descend(n: int, look: Callable[[int, np.ndarray], tuple[np.ndarray, ...]]) -> np.ndarray:
    """Costs of ``n`` strings from the longest context down.

    ``look`` gives, for an order and the strings not coded yet, the count of the string's end of that order, and
    the total, kinds and shorter sum of its context; all are 0 where there is none.
    """
    out = np.zeros(n)
    left = np.arange(n)
    gone_kinds, gone_counts = np.zeros(n), np.zeros(n)
    for order in range(ORDER, -1, -1):
        count, total, kinds_there, shorter = look(order, left)
        met, hit = kinds_there > 0, count > 0
        kinds = kinds_there - gone_kinds[left]
        room = total - gone_counts[left] + kinds
        out[left[hit]] += np.log10(count[hit] / room[hit])
        pays = met & ~hit & (kinds > 0)
        out[left[pays]] += np.log10(kinds[pays] / room[pays])
        seen = left[met]
        gone_kinds[seen], gone_counts[seen] = kinds_there[met], shorter[met]
        left = left[~hit]
    out[left] -= np.log10(ALPHABET - gone_kinds[left])
    return out


class Trie:
    """The learned contexts of all orders."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.levels: list[Level] = []
        grams = grams.astype(np.int64)
        below = None
        for order in range(ORDER + 1):
            pairs, at = np.unique(grams & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            count = np.bincount(at, counts, minlength=len(pairs)).astype(np.int64) if len(grams) else np.zeros(0, np.int64)
            contexts, where = np.unique(pairs >> 8, return_inverse=True)
            sums = lambda x: np.bincount(where, x, minlength=len(contexts)) if len(pairs) else np.zeros(0)
            shorter = np.zeros(len(contexts))
            if below is not None:
                pos, _ = _at(below.pairs, pairs & ((1 << 8 * order) - 1))
                shorter = sums(below.count[pos] if len(below.count) else np.zeros(0))
            below = Level(pairs, count, contexts, sums(count), sums(np.ones(len(pairs))), shorter)
            self.levels.append(below)
        self.table = Table(self.levels[-1].pairs, self.cost(self.levels[-1].pairs))

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each four-byte string after the first three."""
        grams = grams.astype(np.int64)

        def look(order: int, left: np.ndarray) -> tuple[np.ndarray, ...]:
            level, g = self.levels[order], grams[left] & ((1 << 8 * (order + 1)) - 1)
            if not len(level.contexts):
                return tuple(np.zeros(len(left)) for _ in range(4))
            where, met = _at(level.contexts, g >> 8)
            pair, coded = _at(level.pairs, g)
            return (np.where(coded, level.count[pair], 0),
                    *(np.where(met, x[where], 0) for x in (level.total, level.kinds, level.shorter)))

        return descend(len(grams), look)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """log10 probability of each text with its end, and the strings left to be joined: none."""
        grams, sizes = padded(data, offsets)
        none = _listed(np.zeros(0, np.int64), np.zeros(0, np.int64), len(sizes))
        if not len(grams):
            return np.zeros(len(sizes)), none
        logs, known = self.table.get(grams)
        if not known.all():
            rare, at = np.unique(grams[~known], return_inverse=True)
            logs[~known] = self.cost(rare)[at]
        return np.add.reduceat(logs, np.concatenate([[0], np.cumsum(sizes)[:-1]])), none


def _listed(keys: np.ndarray, counts: np.ndarray, n: int) -> pa.Array:
    """For each of ``n`` texts its strings and their counts; a key is the text's number and the string."""
    held = pa.StructArray.from_arrays([pa.array(keys & 0xFFFFFFFF, pa.int64()), pa.array(counts, pa.int64())], ["g", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(keys >> 32, np.arange(n + 1)), pa.int32()), held)


class Frequent:
    """Costs of the most frequent strings of a trie too large for a task."""

    def __init__(self, grams: np.ndarray, costs: np.ndarray):
        self.table = Table(grams, costs)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """The part of each text's log10 probability that is known here, and the strings left to be joined."""
        grams, sizes = padded(data, offsets)
        logs, known = self.table.get(grams)
        text = np.repeat(np.arange(len(sizes)), sizes)
        keys, counts = np.unique((text[~known] << 32) | grams[~known].astype(np.int64), return_counts=True)
        return np.bincount(text, logs, minlength=len(sizes)), _listed(keys, counts, len(sizes))


def costs(wanted: DataFrame, learned: DataFrame) -> DataFrame:
    """g and cost of every wanted string (g), from the counts of all learned ones (g, n), as ``Trie.cost`` has them.

    Each order is two tables that are joined to the strings: counts of pairs, and sums by context. Contexts of two
    bytes and pairs of two are 65,536 at most; a key of three bytes is shared by 256 strings at most.
    """
    found, below, names = wanted.select("g"), None, []
    for order in range(ORDER + 1):
        low = F.col("g").bitwiseAND((1 << 8 * (order + 1)) - 1)
        pairs = learned.groupBy(low.alias("_pair")).agg(F.sum("n").alias(f"count{order}"))
        shorter = pairs.withColumn("_shorter", F.lit(0))
        if below is not None:
            shorter = pairs.withColumn("_below", F.col("_pair").bitwiseAND((1 << 8 * order) - 1)).join(
                below.select(F.col("_pair").alias("_below"), F.col(f"count{order - 1}").alias("_shorter")), "_below")
        contexts = shorter.groupBy(F.shiftright("_pair", 8).alias("_context")).agg(
            F.sum(f"count{order}").alias(f"total{order}"), F.count("*").alias(f"kinds{order}"),
            F.sum("_shorter").cast("long").alias(f"shorter{order}"))
        small = lambda df, at_most: F.broadcast(df) if order <= at_most else df
        found = found.withColumns({"_pair": low, "_context": F.shiftright(low, 8)}).join(
            small(contexts, 2), "_context", "left").join(small(pairs, 1), "_pair", "left").drop("_pair", "_context")
        names.append([f"{x}{order}" for x in ("count", "total", "kinds", "shorter")])
        below = pairs

    def walk(batches):
        for b in batches:
            levels = [[b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in cols] for cols in names]
            logs = descend(b.num_rows, lambda order, left: tuple(x[left] for x in levels[order]))
            yield pa.RecordBatch.from_arrays([b.column("g"), pa.array(logs)], names=["g", "cost"])

    return found.mapInArrow(walk, "g long, cost double")


def _floor_for(counts: DataFrame, most: int) -> int:
    """The least power of two so that at most ``most`` rows have as high a count."""
    steps = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()
    total, floor = 0, 0
    for k, n in sorted(((r["k"], r["count"]) for r in steps), reverse=True):
        total += n
        if total > most:
            floor = k + 1
            break
    return 1 << floor


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """Score every row of ``docs`` (doc_id, held_out, text), learning from ``train`` (text)."""
    low = lower_ascii(F.coalesce("text", F.lit(""))).alias("_low")
    counts = staged(train.select(low).mapInArrow(_gather, "key binary, n long")
                    .groupBy("key").agg(F.sum("n").alias("n")), "scoring-counts")
    kind = F.substring("key", 1, 1)
    words, grams = counts.where(kind == F.lit(b"t")), counts.where(kind == F.lit(b"g"))
    whole = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, kinds = whole["n"], whole["v"]

    learned = grams.select(F.conv(F.hex(F.substring("key", 2, ORDER + 1)), 16, 10).cast("long").alias("g"), "n")
    whole_trie = learned.count() <= MAX_NODES
    if whole_trie:
        nodes = learned.toPandas()
        model = Trie(nodes["g"].to_numpy(np.int64), nodes["n"].to_numpy(np.int64))
    else:
        nodes = costs(learned.where(F.col("n") >= _floor_for(learned, MAX_NODES)), learned).toPandas()
        model = Frequent(nodes["g"].to_numpy(np.int64), nodes["cost"].to_numpy(np.float64))
    floor = _floor_for(words, MAX_HELD_WORDS)
    frequent = words.where(F.col("n") >= floor).toPandas()
    held = dict(zip((k[1:] for k in frequent["key"]), frequent["n"].tolist()))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, held_out boolean, row long, n_tokens long, held_known long, held_logs double, "
              "score double, rare array<struct<key:binary,n:long>>, rare_grams array<struct<g:long,n:long>>")
    rare_type = pa.list_(pa.struct([("key", pa.binary()), ("n", pa.int64())]))

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for piece, data, offsets in chunks(batches, "_low"):
            tokens, known, logs, rare = [], [], [], []
            for a, b in zip(offsets, offsets[1:]):
                found = Counter(data[a:b].tobytes().split())
                found[END_WORD] += 1
                tokens.append(sum(found.values()))
                got = [(held[w], n) for w, n in found.items() if w in held]
                known.append(sum(n for _, n in got))
                logs.append(float(np.dot(np.log10([c + 1 for c, _ in got]), [n for _, n in got])) if got else 0.0)
                rare.append([{"key": b"t" + w, "n": n} for w, n in found.items() if w not in held])
            n = piece.num_rows
            scores, rare_grams = model.score(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(np.arange(row, row + n)), pa.array(tokens, pa.int64()),
                 pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(scores),
                 pa.array(rare, rare_type), rare_grams],
                names=["doc_id", "held_out", "row", "n_tokens", "held_known", "held_logs", "score", "rare", "rare_grams"])
            row += n

    scored = staged(docs.select("doc_id", "held_out", low).mapInArrow(run, schema), "scoring-rows")
    # An unseen word adds log10(0 + 1) = 0, so the inner join loses nothing.
    joined = scored.select("row", F.explode("rare").alias("r")).select("row", "r.key", F.col("r.n").alias("times")) \
        .join(words.where(F.col("n") < floor), "key") \
        .groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    zero = F.lit(0)
    score_of = F.col("score")
    if not whole_trie:
        strings = scored.select("row", F.explode("rare_grams").alias("r")).select("row", "r.g", F.col("r.n").alias("times"))
        below = strings.join(costs(strings.select("g").distinct(), learned), "g").groupBy("row").agg(
            F.sum(F.col("times") * F.col("cost")).alias("below"))
        scored = scored.join(below, "row", "left")
        score_of = score_of + F.coalesce("below", zero)
    return scored.join(joined, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("held_known") + F.coalesce("known", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("held_logs") + F.coalesce("logs", zero)
         - F.col("n_tokens") * float(np.log10(total + kinds + 1))).alias("base_score"),
        score_of.alias("score"))
