"""Ranked search, toxicity and the conversation trie against plain versions, on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import A, B, LONG, docs

from textpace.llm import lexical_search, prefix_trie, toxicity
from textpace.llm.common import crc_mod
from pyspark.sql import functions as F

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def ranking(rows, items, k=10):
    docs_ = [(i, Counter(terms(t))) for i, t in rows]
    n = sum(1 for _, w in docs_ if w)
    total = sum(w.total() for _, w in docs_)
    held = Counter(t for _, w in docs_ for t in w)
    out = []
    for item, text in items:
        found = []
        for i, w in docs_:
            score = 0
            for t in set(terms(text)) & set(w):
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1)))
                score += weight * (1_000_000_000 * w[t] // (1000 * w[t] + 8 * (10 + 90 * w.total() * n // total)))
            if score:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


ITEMS = [(1, A), (2, "Quick FOX, owls"), (3, None), (4, "..."), (None, "word1 item9"), (2, "Quick FOX, owls"), (5, "Eulen ünïcödé 12345"), (6, LONG)]


@pytest.mark.parametrize("query_bytes, block_bytes, short, window", [(1 << 20, 1 << 20, 256, 512), (100_000, 300, 2, 2)])
def test_ranking(spark, query_bytes, block_bytes, short, window):
    df = docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id bigint, text string, score string")
    got = lexical_search.search(df, items, 4, query_bytes, block_bytes, short, window)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranking(rows, ITEMS, 4)


def test_ranking_skips_but_loses_nothing(spark):
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(draw.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=draw.randint(1, 40)))) for i in range(400)]
    rows += [(i + 1000, t) for i, t in rows[:50]]
    items = [(i, " ".join(draw.sample(vocabulary, 12))) for i in range(12)]
    got = lexical_search.search(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3),
                                spark.createDataFrame(items, "item_id bigint, text string"), 10, 1 << 20, 2000, 20, 16)
    assert sorted(map(tuple, got.collect()), key=str) == ranking(rows, items)


def test_ranking_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical_search.search(empty, items).count() == 0
    assert lexical_search.search(docs(spark), items.limit(0)).count() == 0


INSULTS = ["blockhead", "nitwit"]


def labelled(n=240, seed=3):
    draw = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "su") for b in ("ra", "ti", "vo", "we", "xu", "zy")]
    rows = []
    for i in range(n):
        text = [draw.choice(plain) for _ in range(draw.randint(30, 120))]
        if i % 4 == 0:
            for w in draw.choices(INSULTS, k=4):
                text.insert(draw.randrange(len(text)), w)
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    return rows


def test_toxicity_is_told_from_other_texts(spark):
    rows = labelled()
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = toxicity.fit(table, table.where(~held_out))
    got = {r["doc_id"]: r for r in toxicity.predict(table.where(held_out), model).collect()}
    assert set(got) == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    right = sum(got[i]["predicted"] == t for i, _, t in rows if i in got)
    assert right >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_toxic_evidence_equals_a_plain_version(spark):
    rows = labelled(60)
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(table, table)
    contexts = {k: {(u, w) for _, t, y in rows if y == k or k == 2 for u, w in zip([None] + t.split(), t.split())} for k in (0, 1, 2)}
    contexts[2] = contexts[0] | contexts[1]
    spread = {k: {} for k in contexts}
    for k, pairs in contexts.items():
        for _, w in pairs:
            spread[k][w] = spread[k].get(w, 0) + 1
    kinds, size = len(spread[2]), {k: len(v) for k, v in contexts.items()}

    def probability(k, w, d=model.discount):
        shared = max(spread[2].get(w, 0) - 0.75, 0) / size[2] + 0.75 * kinds / size[2] / (kinds + 1)
        taken = sum(min(n, d) for n in spread[k].values()) / size[k]
        return max(spread[k].get(w, 0) - d, 0) / size[k] + taken * shared

    texts = [rows[0][1], "nitwit never seen", rows[1][1], ""]
    raw = [t.encode() for t in texts]
    found = toxicity.evidence(model, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]), (model.discount,))
    for text, x in zip(texts, found[:, 0]):
        logs = [math.log(0.995 + 0.005 * probability(1, w) / probability(0, w)) for w in text.split()]
        assert x == pytest.approx(sum(logs) / max(len(logs), 1), rel=1e-4, abs=1e-9)


def test_own_contexts():
    raw = [b"a b a b a", b"", b"b b b"]
    found, rows = toxicity.words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    assert rows.tolist() == [0, 5, 5, 8]
    assert toxicity.own_contexts(found, rows).tolist() == [2, 1, 2, 1, 2, 2, 2, 2]


def test_toxicity_of_awkward_rows(spark):
    df = docs(spark)
    both = df.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).when(F.col("doc_id") > 3, 0).alias("toxic"))
    for lab in (both, both.where("toxic = 1"), both.where("toxic = 0"), both.limit(0)):
        out = toxicity.predict(df.withColumn("predicted", F.lit("old")), toxicity.fit(df, lab))
        rows = out.collect()
        assert len(rows) == df.count() and out.columns.count("score") == 1 and out.columns[-2:] == ["score", "predicted"]
        assert all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if not r["text"]}) == 1


def trie(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            key = f"{len(role or '')}:{role or ''}{text or ''}"
            turns.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(key.encode()).hexdigest()[:32], role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    members, stops = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        stops.setdefault(tuple(path), []).append(c)
    children, totals, out = {}, {}, []
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    for node in sorted(members, key=len, reverse=True):
        below = [totals[x] for x in children.get(node, [])]
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        totals[node] = (sum(x for x, _ in below) or 1, own + sum(x for _, x in below))
        ids = ",".join(map(str, sorted(stops.get(node, []))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]),
                    len(below), *totals[node], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(n, seed=1):
    draw = random.Random(seed)
    rows = [(draw.choice([c, c, c, 7]), draw.choice([None, 0, 1, 2, 3, 4]), draw.choice(["user", "bot", None]), draw.choice(["a", "bé", "", None]))
            for c in range(-5, 330) for _ in range(draw.randint(0, 4))][:n]
    return rows + [(None, 1, "user", "lost"), (400, 3, "bot", "same"), (400, 3, "bot", "same"), (100, None, None, None)]


@pytest.mark.parametrize("limit", [1 << 14, 3])
def test_trie(spark, limit):
    rows = talk(500) + [(9000 + i % 2 * 200, t, "user", "deep") for i in range(2) for t in range(60)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth string")
    got = prefix_trie.rollup(table.repartition(4), limit, 20)
    assert sorted(map(tuple, got.collect()), key=str) == trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.rollup(empty).count() == 0
    # One turn that is taken off and nothing lent: only the root.
    lonely = next(c for c in range(101, 200) if prefix_trie.borrowed(c))
    table = spark.createDataFrame([(lonely, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    assert list(map(tuple, prefix_trie.rollup(table).collect())) == trie([(lonely, 0, "user", "a")])


def test_long_conversation_lies_in_several_ranges(spark):
    rows = [(3, t, "user", f"t{t % 17}") for t in range(3000)] + [(4, t, "user", f"t{t % 17}") for t in range(2000)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(tuple, prefix_trie.rollup(table, 700).collect()), key=str) == trie(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


def test_decompose_equals_a_walk():
    draw = random.Random(2)
    for n in (1, 2, 7, 60):
        parent = [-1] + [draw.randrange(i) for i in range(1, n)]
        leaf, saved = [draw.randint(0, 1) for _ in range(n)], [draw.randint(0, 9) for _ in range(n)]
        want = [list(leaf), list(saved)]
        for v in range(n - 1, 0, -1):
            for w in want:
                w[parent[v]] += w[v]
        order = sorted(range(n), key=lambda v: (depth_of(parent, v), v))
        at = {v: j for j, v in enumerate(order)}
        got = prefix_trie.decompose([at.get(parent[v], -1) for v in order], [leaf[v] for v in order], [saved[v] for v in order])
        assert [[w[v] for v in order] for w in want] == [list(g) for g in got]


def depth_of(parent, v):
    return 0 if parent[v] < 0 else 1 + depth_of(parent, parent[v])
