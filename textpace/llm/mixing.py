"""Mixing sources to target weights.

Each source's words are packed end to end into blocks of fixed length. The run's slots are
dealt to output shards by drawing source counts per shard from the multinomial law, given
the totals: a tree over the shards splits the totals in two at each node, so every shard
finds its own counts and ranks alone. A slot's rank within its source goes through a
pseudorandom permutation of that source's blocks, and a join on (source, block) fetches
the words.

Rules for odd input: null or empty texts have no words and are never taken; a null source
is a source of its own, last in order; rows that repeat an id are separate documents; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from textpace.llm.common import WORD, staged

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 256
SHARD_SLOTS = 1024
MAX_REPEATS = 3
# The list of sources is held by the driver and sent to all tasks; more are refused.
MAX_SOURCES = 10_000
SEED = 7919
# Up to so many slots are drawn one by one; a speed setting only.
SINGLE_DRAWS = 64


@dataclass(frozen=True)
class Source:
    """One source in mixing order; ``words`` are those the mix takes."""
    index: int
    name: str | None
    size: int
    target: float
    words: int

    def slots(self, block: int) -> int:
        if not self.size:
            return 0
        rounds, rest = divmod(self.words, self.size)
        return rounds * -(-self.size // block) + -(-rest // block)


@dataclass(frozen=True)
class Mix:
    """``ledger``: a row per document. ``pieces``: the words of each slot in reading order."""
    ledger: DataFrame
    pieces: DataFrame


def share_out(sizes: list[int], weights: list[float], total: float, most: int) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is shared anew."""
    got = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes))]
    left = float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                got[i] = unit * weights[i]
            break
        for i in over:
            got[i] = float(most * sizes[i])
            left -= got[i]
        open_ = [i for i in open_ if i not in set(over)]
    return got


def order_sources(found: list[tuple[str | None, int]], weights, most: int) -> list[Source]:
    found = sorted(found, key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [int(n) for _, n in found]
    shares = share_out(sizes, [weights[i % len(weights)] for i in range(len(sizes))], sum(sizes), most)
    return [Source(i, name, n, t, min(int(round(t)), most * n))
            for i, ((name, _), n, t) in enumerate(zip(found, sizes, shares))]


def split_counts(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``n`` slots, drawn from ``counts`` without replacement, fall to each source.

    Every slot is taken with probability n over all, which misses n by about its root; the
    surplus or what lacks is drawn the same way, so the slots taken are any n with equal
    chance. Each step leaves the root of the one before it, and a few slots are drawn singly.
    """
    total = int(counts.sum())
    if n >= total:
        return counts.copy()
    if 2 * n > total:
        return counts - split_counts(counts, total - n, rng)
    if n <= SINGLE_DRAWS:
        slots: set[int] = set()
        while len(slots) < n:
            slots.add(int(rng.integers(total)))
        owners = np.searchsorted(np.cumsum(counts), sorted(slots), side="right")
        return np.bincount(owners, minlength=len(counts)).astype(np.int64)
    got = rng.binomial(counts, n / total).astype(np.int64)
    over = int(got.sum()) - n
    if over > 0:
        return got - split_counts(got, over, rng)
    return got + split_counts(counts - got, -over, rng) if over else got


def shard_counts(totals: np.ndarray, shard: int, shards: int, size: int, seed: int):
    """Source counts of one shard, and how many slots of each source came before it."""
    lo, hi, counts, before = 0, shards, totals, np.zeros_like(totals)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, lo * (shards + 1) + hi]))
        left = split_counts(counts, (mid - lo) * size, rng)
        if shard < mid:
            hi, counts = mid, left
        else:
            lo, counts, before = mid, counts - left, before + left
    return counts, before


def permuted(ranks: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom bijection of 0..n-1: a Feistel network, walked until it lands inside."""
    if n < 2:
        return ranks.copy()
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.Generator(np.random.Philox(key=[key, n])).integers(1, 1 << 62, 6, dtype=np.uint64)

    def once(x):
        a, b = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            a, b = b, a ^ ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)) & mask
        return (a << np.uint64(half)) | b

    out = once(ranks.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def slot_rows(sources: list[Source], shard: int, shards: int, block: int, size: int, seed: int) -> pd.DataFrame:
    """The slots of one shard: source, block and how many of the block's words are used."""
    totals = np.array([s.slots(block) for s in sources], np.int64)
    counts, before = shard_counts(totals, shard, shards, size, seed)
    parts = []
    for s in sources:
        if not (n := int(counts[s.index])):
            continue
        rank = before[s.index] + np.arange(n)
        per_round, full = -(-s.size // block), s.size // block
        turn, place = rank // per_round, rank % per_round
        chosen = np.where(place < full, place, full)
        for t in np.unique(turn):
            here = (turn == t) & (place < full)
            chosen[here] = permuted(place[here], full, seed * 1_000_003 + s.index * 31 + int(t))
        use = np.full(n, block, np.int64)
        if rest := s.words % s.size:
            use[rank == totals[s.index] - 1] = rest - (-(-rest // block) - 1) * block
        parts.append(pd.DataFrame({"source_idx": s.index, "block": chosen, "use": use}))
    out = pd.concat(parts) if parts else pd.DataFrame({"source_idx": [], "block": [], "use": []})
    rng = np.random.Generator(np.random.Philox(key=[seed + 1, shard]))
    out.insert(0, "slot", shard * size + rng.permutation(len(out)))
    out.insert(0, "shard", shard)
    return out.astype("int64")


def mix(docs: DataFrame, weights=WEIGHTS, block: int = BLOCK, most: int = MAX_REPEATS,
        shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Mix:
    """Mix ``docs`` (doc_id, source, text) to the weights, repeated along the sorted sources."""
    spark = docs.sparkSession
    sized = staged(docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    found = per_source.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = order_sources([(r["source"], r["size"]) for r in found], weights, most)
    known = spark.createDataFrame(
        [(s.index, s.name, s.size, s.target) for s in sources],
        "source_idx int, _name string, source_size long, target double")

    # Offsets are summed inside buckets and over bucket totals: about as many rows either way.
    buckets = max(1, math.isqrt(sum(r["rows"] for r in found)))
    key = ["source_idx", "bucket"]
    named = sized.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_name"))).drop("_name") \
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)))
    inside = Window.partitionBy(*key).orderBy("doc_id", "size")
    placed = named.select(
        "*", F.row_number().over(inside).alias("row"),
        (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("_at"))
    earlier = Window.partitionBy("source_idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = named.groupBy(*key).agg(F.sum("size").alias("_n")).select(
        *key, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    start = F.col("_base") + F.col("_at")
    spans = placed.where("size > 0").join(bases, key).select(
        *key, "row", "doc_id", start.alias("begin"), (start + F.col("size")).alias("end")).select(
        "*", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))).alias("block"))

    slots = sum(s.slots(block) for s in sources)
    shards = -(-slots // shard_slots)

    def deal(frames):
        for frame in frames:
            for shard in frame["id"]:
                yield slot_rows(sources, int(shard), shards, block, shard_slots, seed)

    dealt = spark.range(shards).mapInPandas(
        deal, "shard long, slot long, source_idx long, block long, use long") \
        .withColumn("source_idx", F.col("source_idx").cast("int"))
    first = F.greatest(F.col("begin"), F.col("block") * block)
    last = F.least(F.col("end"), F.col("block") * block + F.col("use"))
    # Both sides grow with the data; the planner cannot see how many rows the slots are.
    pieces = spans.join(dealt.hint("merge"), ["source_idx", "block"]).where(last > first).select(
        "shard", "slot", *key, "row", "doc_id", (first - F.col("begin")).alias("first_word"),
        (last - first).alias("n_words"), (first - F.col("block") * block).alias("offset"))
    taken = pieces.groupBy(*key, "row").agg(F.sum("n_words").alias("taken"))
    ledger = placed.join(taken, [*key, "row"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
    return Mix(ledger, pieces.drop("bucket", "row"))
