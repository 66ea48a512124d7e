"""Each operator on awkward rows, against plain versions."""

import math
import random
from collections import Counter

import corpus_pipeline
import llm_cases as cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from textpace.llm import (anchors, components, decontamination, html_templates, langid, mixing, privacy, quality, scoring,
                          shingle_join, suffix_dedup, url_templates)


@pytest.fixture(scope="module")
def docs(spark):
    return cases.docs(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return cases.docs(spark, [])


def noisy(seed, n=120):
    """Texts that share passages, with copies and near copies."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    common = [" ".join(rng.choices(vocabulary, k=20)) for _ in range(4)]
    out = []
    for i in range(n):
        text = rng.choices(vocabulary, k=rng.randint(0, 90))
        if rng.random() < 0.5:
            text[len(text) // 2:len(text) // 2] = rng.choice(common).split()
        if out and rng.random() < 0.4:
            text = rng.choice(out)[1].split(" ")
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
        out.append((i * 7 % 1000, " ".join(text)))
    return out


# --- mixing -------------------------------------------------------------------------------

def test_mix(spark, docs, empty):
    rows = mixing.mix(docs, block=16, shard_slots=8).ledger.collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r[0], len(cases.words(r[1]))) for r in cases.RAW)
    size = Counter()
    for _, t, _, s in cases.RAW:
        size[s] += len(cases.words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    left, share, live = sum(size.values()), {}, set(order)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while live:
        unit = left / sum(weight[s] for s in live)
        over = {s for s in live if unit * weight[s] > 3 * size[s]}
        if not over:
            share |= {s: unit * weight[s] for s in live}
            break
        share |= {s: 3 * size[s] for s in over}
        left -= sum(share[s] for s in over)
        live -= over
    taken = Counter()
    for r in rows:
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], share[r["source"]], abs_tol=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - share[s]) <= 1 for s in order)
    again = mixing.mix(docs.repartition(5), block=16, shard_slots=8).ledger
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, rows))
    assert mixing.mix(empty).ledger.count() == 0


def test_mix_fills_every_slot_once(docs):
    pieces = mixing.mix(docs, block=16, shard_slots=8).pieces.collect()
    by_slot = {}
    for p in pieces:
        by_slot.setdefault(p["slot"], []).append((p["offset"], p["n_words"], p["shard"]))
    assert sorted(by_slot) == list(range(len(by_slot)))
    for slot, parts in by_slot.items():
        parts.sort()
        assert parts[0][0] == 0 and slot // 8 == parts[0][2]
        assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and sum(p[1] for p in parts) <= 16


def test_permutation_and_split():
    for n in (1, 2, 3, 17, 256, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))
    totals = np.array([100, 0, 37, 900])
    got = [mixing.shard_counts(totals, s, 11, 100, 1) for s in range(11)]
    assert (sum(c for c, _ in got) == totals).all()
    assert all((got[s][1] == sum((c for c, _ in got[:s]), np.zeros(4, int))).all() for s in range(11))
    big = mixing.split_counts(np.array([3 * 10**9, 10**9]), 10**9, np.random.default_rng(1))
    assert big.sum() == 10**9


# --- language -----------------------------------------------------------------------------

def test_language(spark, docs, empty):
    model = langid.fit(docs.where("doc_id NOT IN (10, 11, 16, 17)"))
    assert model.languages == ["de", "en"]
    got = {(r["doc_id"], r["text"]): r for r in langid.predict(docs, model).collect()}
    assert got[1, cases.A]["lang_pred"] == "en" and got[4, cases.B]["lang_pred"] == "de"
    for i, text in ((5, None), (6, ""), (7, " \t\n\x0b "), (12, "12345 67890 !!!")):
        assert got[i, text]["lang_pred"] == "und" and got[i, text]["score"] == 0 and got[i, text]["ambiguous"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1, cases.A]["kept"] == "old"
    blank = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.predict(docs, blank).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_codewords():
    for n in (2, 4, 6, 9, 30):
        code = langid.codewords(n)
        apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
        assert min(apart) >= (1 if n < 4 else 3) and (np.abs(code.sum(0)) < n).all()


# --- decontamination ----------------------------------------------------------------------

def edits_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_decontamination(spark, docs, empty):
    rng = random.Random(3)
    item = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(30))
    short = "tiny item"

    def edited(n):
        text = list(item)
        for _ in range(n):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        return "".join(text)
    rows = [(i, f"before {edited(i // 2)} after. {i}", "en", "a") for i in range(40)]
    bench = spark.createDataFrame([(0, item, "x"), (1, item.upper() + "!", "x"), (2, short, "x"), (3, None, "x"), (4, "", "x")],
                                  "item_id long, text string, doc_id string")
    table = cases.docs(spark, rows + cases.RAW)
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.matches(table, bench).where("start_at >= 0").collect()}
    form = decontamination.plain(item)
    budget = int(decontamination.EDIT_RATE * len(form))
    expected = {}
    for i, text, _, _ in rows:
        n = edits_inside(form, decontamination.plain(text))
        if n <= budget:
            expected |= {(i, 0): n, (i, 1): n}
    assert got == expected and 4 < len(expected) < 80
    kept = decontamination.clean(table, bench)
    assert kept.columns == table.columns
    assert kept.count() == len(rows) + len(cases.RAW) - len({i for i, _ in expected})
    assert decontamination.matches(empty, bench).count() == 0
    assert decontamination.matches(table, bench.limit(0)).count() == 0 and decontamination.clean(table, bench.limit(0)).count() == table.count()


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(300):
        pattern = "".join(rng.choices("abc", k=rng.randint(1, 90)))
        text = "".join(rng.choices("abc", k=rng.randint(0, 120)))
        want = edits_inside(pattern, text)
        hit = decontamination.Pattern(pattern, len(pattern)).search(text)
        assert (hit[0] if hit else len(pattern)) == min(want, len(pattern)) or not text


# --- quality ------------------------------------------------------------------------------

def test_quality(docs, empty):
    got = quality.cascade(docs).collect()
    assert len(got) == len(cases.RAW) and {r["score"] for r in got} == {"old"}
    for r in got:
        t = r["text"] or ""
        w, lines = cases.words(t), [x for x in t.split("\n") if cases.words(x)]
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w))
        assert r["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>") and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == cases.repeated_words(t)
        failed = len(w) < 20 or 100 * r["n_repeat_words"] > 30 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"]) and (r["failed_rule"] is None) == r["kept"]
    assert {r["doc_id"] for r in got if r["kept"]} >= {1, 2, 3, 4, 10, 11}
    assert quality.cascade(empty).count() == 0


def test_rules_run_by_rejections_per_second():
    rules = [quality.Rule(n, lambda t: False) for n in "abc"]
    assert [r.name for r in quality.ordered(rules, [("a", 1.0, 0.1), ("b", 0.1, 0.1), ("c", 1.0, 0.9)])] == ["b", "c", "a"]


# --- scoring ------------------------------------------------------------------------------

def slow_cost(grams, key):
    """log10 probability by plain partial matching with exclusion; ``grams``: Counter of 4-byte strings."""
    context, symbol, excluded, total = key[:3], key[3], set(), 0.0
    for order in (3, 2, 1, 0):
        tail = context[3 - order:]
        seen = Counter()
        for g, n in grams.items():
            if g[3 - order:3] == tail:
                seen[g[3]] += n
        fresh = {s: n for s, n in seen.items() if s not in excluded}
        if not fresh:
            excluded |= set(seen)
            continue
        room = sum(fresh.values()) + len(fresh)
        if symbol in fresh:
            return total + math.log10(fresh[symbol] / room)
        total += math.log10(len(fresh) / room)
        excluded |= set(seen)
    return total - math.log10(256 - len(excluded))


def byte_grams(text):
    raw = b"\xff\xff\xff" + cases.lowered(text).encode() + b"\xff"
    return [raw[i:i + 4] for i in range(len(raw) - 3)]


def test_scoring(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(scoring, "MAX_HELD_WORDS", 4)          # most words go through the join
    small = cases.docs(spark, [r for r in cases.RAW if r[0] not in (10, 11, 17)])
    held = F.col("doc_id").isin(3, 14)
    got = scoring.score(small.withColumn("held_out", F.coalesce(held, F.lit(False))), small.where(F.coalesce(~held, F.lit(True)))).collect()
    rows = [(i, t) for i, t, _, _ in cases.RAW if i not in (10, 11, 17)]
    counts, grams = Counter(), Counter()
    for i, t in rows:
        if i not in (3, 14):
            counts.update([*cases.words(cases.lowered(t)), " "])
            grams.update(byte_grams(t))
    total, kinds = sum(counts.values()), len(counts)
    cost = {g: slow_cost(grams, g) for _, t in rows for g in set(byte_grams(t))}
    want = sorted((i is None, i or 0, len(w := [*cases.words(cases.lowered(t)), " "]), sum(counts[x] > 0 for x in w), total,
                   round(sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w), 6),
                   round(sum(cost[g] for g in byte_grams(t)), 6)) for i, t in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6),
                   round(r["score"], 6)) for r in got) == want
    nothing = scoring.score(small.withColumn("held_out", F.lit(True)), empty).where("doc_id = 6").first()
    assert nothing["base_score"] == 0 and math.isclose(nothing["score"], -math.log10(256))
    assert scoring.score(empty.withColumn("held_out", F.lit(True)), small).count() == 0


def test_costs_are_a_distribution():
    grams = Counter(byte_grams("abracadabra abracadabra") + byte_grams("cabbage"))
    trie = scoring.Trie(np.array([int.from_bytes(g, "big") for g in grams]), np.array(list(grams.values())))
    for context in (b"abr", b"xxx", b"xab", b"\xff\xff\xff"):
        keys = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)])
        assert math.isclose((10 ** trie.cost(keys)).sum(), 1, abs_tol=1e-9)
        assert all(math.isclose(c, slow_cost(grams, context + bytes([s]))) for s, c in enumerate(trie.cost(keys)))


# --- urls ---------------------------------------------------------------------------------

def test_urls(spark):
    urls = [None, "", "no scheme", "http://a.net", "http://a.net/x", "https://B.Example.NET/en/1?q=/fr/", "http://x.example.net/de/1",
            "http://example.com/de/a#b", "http://notexample.com/de/a", "http://w.org/fr/", "http://w.org/fr", "ftp://org/fr/x", "x://net/"]
    hosts = [f"http://shop.site/{'sale' if i % 2 else 'news'}/{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls + hosts + ["http://a.net/x"])], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_templates.judge(pages).collect()}
    assert len(got) == len(urls) + len(hosts) + 1
    rule = [None, None, None, None, "net/", "example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, "org/fr/", "net/"]
    assert [got[i]["rule"] for i in range(len(urls))] == rule
    assert got[5]["host"] == "b.example.net" and got[5]["path"] == "/en/1" and got[2]["host"] == got[0]["path"] == ""
    assert [got[i]["verdict"] for i in (4, 5, 7, 9)] == ["block", "allow", "block", "allow"] and got[0]["verdict"] == "allow"
    assert url_templates.judge(pages.limit(0)).count() == 0
    # Labelled pages of one branch spread to its unlabelled ones, and to no other branch.
    labelled = pages.where("page_id >= 13").selectExpr("'shop.site' AS host", "page_id % 2 = 1 AS spam", "page_id", "url")
    paths = labelled.selectExpr("host", "concat('/', if(spam, 'sale', 'news'), '/', page_id) AS path", "1L AS pages",
                                "if(spam AND page_id % 10 < 9, 1L, 0L) AS blocked", "if(NOT spam, 1L, 0L) AS allowed")
    tree = url_templates.grow(paths).groupBy("template").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a")).collect()
    assert {(r["template"].split("/")[1].strip("*"), r["b"] > 0, r["a"] > 0) for r in tree} <= {
        ("sale", True, False), ("news", False, True), ("blocked", True, False), ("allowed", False, True)} and len(tree) == 2


# --- passages -----------------------------------------------------------------------------

@pytest.mark.parametrize("bucket_bytes", [1 << 20, 700])
def test_passages(spark, bucket_bytes):
    rows = [(i, t) for i, t, _, _ in cases.RAW] + noisy(1)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.dedup(table, bucket_bytes=bucket_bytes).collect()
    assert Counter(map(tuple, got)) == Counter(cases.passages(rows))
    assert suffix_dedup.dedup(table.limit(0)).count() == 0


def test_long_texts_are_cut_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 9000, dtype=np.uint8)
    whole = anchors.find(data, np.array([0, 9000]), 50)
    monkeypatch.setattr(anchors, "PIECE", 1000)
    parts = anchors.find(data, np.array([0, 9000]), 50)
    for found in (whole, parts):
        named = np.concatenate([np.arange(a, b + 1) for a, b in zip(found.first, found.last)])
        assert sorted(named) == list(range(9000 - 49))


def test_deep_shallow_sort():
    rng = random.Random(4)
    stem = "".join(rng.choices("ab", k=40)).encode()
    text = b"".join(stem + bytes(rng.choices(b"ab", k=12)) for _ in range(300)) + bytes(rng.choices(b"ab", k=400))
    data = np.frombuffer(text, np.uint8)
    starts = np.arange(len(data) - 49)
    order, label = suffix_dedup.deep_shallow(data, starts)
    strings = [text[s:s + 50] for s in starts[order]]
    assert strings == sorted(strings)
    assert all((a == b) == (x == y) for a, b, x, y in zip(strings, strings[1:], label, label[1:]))
    for values in ([], [0], [5, -3, 2**40], [2**63 - 1, 0]):
        assert suffix_dedup.unpack(suffix_dedup.pack(np.array(values, np.int64)))[0].tolist() == values


# --- privacy ------------------------------------------------------------------------------

def test_privacy(spark, docs, empty):
    got = privacy.find(docs).select("doc_id", privacy.listed(F.col("base")).alias("base")).collect()
    assert Counter(map(tuple, got)) == Counter((i, cases.private(t)) for i, t, _, _ in cases.RAW)
    clean = privacy.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(cases.RAW)
    by_id = {r["doc_id"]: r for r in clean.collect()}
    assert by_id[13]["text"] == "Write to <email> or <phone>, card <card>, host <ip> not 10.0.0.256."
    assert by_id[13]["n_chars"] == len(by_id[13]["text"]) and by_id[5]["text"] is None and by_id[1]["text"] == cases.A
    assert privacy.sanitise(empty).count() == 0 and privacy.find(empty).count() == 0


def test_random_private_texts(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("0123456789.-+ @ab_()é", k=rng.randint(0, 60)))) for i in range(400)]
    got = privacy.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", privacy.listed(F.col("base")))
    assert sorted(map(tuple, got.collect())) == [(i, cases.private(t)) for i, t in rows]


def test_terms_that_reveal(spark):
    rows = [(i, f"note {i} from Zorblatt the agent mail zb@corp.example the end {i}") for i in range(6)]
    rows += [(100 + i, f"the agent went home and the note {i} was from nobody") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {s["value"] for r in privacy.find(docs).collect() for s in r["terms"]}
    assert "zorblatt" in terms and "the" not in terms and "agent" not in terms
    text = privacy.sanitise(docs).where("doc_id = 2").first()["text"]
    assert "Zorblatt" not in text and "zb@corp" not in text and "agent" in text


# --- shingle join -------------------------------------------------------------------------

@pytest.mark.parametrize("how", [{}, {"bucket_bytes": 600, "tree_sets": 3}])
def test_shingle_join(spark, how):
    rows = [(i, t) for i, t, _, _ in cases.RAW] + noisy(2, 150) + [(5000 + i, cases.A + f" tail {i // 2}") for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = shingle_join.join(table, **how).collect()
    want = Counter((i, *c) for (i, _), c in zip(rows, cases.components(rows)))
    assert Counter(map(tuple, got)) == want
    assert shingle_join.join(table.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark, docs, empty):
    kept = shingle_join.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 4, 5, 6, 7, 8, 10, 12, 13, 14, 15, 16, 17], key=str)
    assert shingle_join.representatives(empty).count() == 0


@pytest.mark.parametrize("how", [{}, {"bucket_bytes": 600, "tree_sets": 3}])
def test_shingles_of_five_words(spark, how):
    rows = [(i, t) for i, t, _, _ in cases.RAW] + noisy(3, 150)
    got = shingle_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 80, 5, **how).collect()

    def shingles(text):
        w = cases.words(cases.lowered(text))
        return {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    sets, root = [shingles(t) for _, t in rows], {i: i for i in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root.update({k: new for k, v in root.items() if v == old})
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    want = Counter((i, len(sets[k]), least.get(root[k]) if sets[k] else i) for k, (i, _) in enumerate(rows))
    assert Counter(map(tuple, got)) == want


def test_pipeline_links_copies_with_one_word_replaced(spark):
    text = [f"w{i}" for i in range(54)]
    table = cases.docs(spark, [(1, " ".join(text), "en", "a"), (2, " ".join([*text[:27], "other", *text[28:]]), "en", "a"),
                               (3, " ".join([*text[:18], "x", *text[19:36], "y", *text[37:]]), "en", "a")])
    assert sorted(r["doc_id"] for r in corpus_pipeline.distinct(spark, table, "").collect()) == [1, 3]
    assert shingle_join.representatives(table).count() == 3


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == {x: find(x) for x in root}


# --- html ---------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{x:"</p>"}}</style><script>var a="<p>no</p>";</script>
<nav><ul><li>Menu</li></ul></nav><header class="top"><a>Site</a></header><div class="cookie-notice">Accept &amp; go</div>
<{main}><h1>Head &lt;{i}&gt;</h1><p>First  <b>bold<br>line<p>Second&nbsp;{i}<ul><li>One<li>Two</ul>
<div class="ad-box">Buy</div><div id="comments"><p>Reader {i}</p></div></{end}><aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    pages = [(i, f"http://h.example/{i}", PAGE.format(i=i, main="article", end="article"), "old") for i in range(4)]
    pages += [(10 + i, f"http://d.example/{i}", PAGE.format(i=i, main='div class="content"', end="div") + f"<div>tail {'same'}</div>", "old")
              for i in range(4)]
    pages += [(20, None, None, "old"), (21, "x", "", "old"), (22, "http://p.example/", "just text &amp; more", "old"),
              (23, "http://q.example/", "<p>open <b>tags", "old"), (24, "http://q.example/", "<" * 3000 + "a", "old"), (0, "http://h.example/0", pages[0][2], "old")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = html_templates.extract(table).collect()
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    for i in range(4):
        assert text[i] == f"Head <{i}>\n\nFirst bold line\n\nSecond {i}\n\nOne\n\nTwo" == text[10 + i]
    assert text[20] == text[21] == "" and text[22] == "just text & more" and text[23] == "open tags"
    assert html_templates.extract(table.limit(0)).count() == 0


def read_pages(spark, sources):
    table = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(sources)], "page_id long, url string, html string")
    return [r["text"] for r in html_templates.extract(table).orderBy("page_id").collect()]


def test_html_outside_the_largest_region(spark):
    """Titles, leads and stories beside one large or one named element stay; text that never changes goes."""
    bodies = [
        "<h1>Title {i}</h1><p>Intro {i}</p><div class=text><p>" + "Long story {i}. " * 20 + "</p></div><div class=fixed>Same line</div>",
        "<main><p>The story {i}</p></main><article>Teaser {i}</article>",
        "<main><h1>Head {i}</h1><p>Lead {i}</p><article><p>Body {i}</p></article></main>",
    ]
    want = ["Title {i}\n\nIntro {i}\n\n" + " ".join(["Long story {i}."] * 20), "The story {i}\n\nTeaser {i}",
            "Head {i}\n\nLead {i}\n\nBody {i}"]
    got = read_pages(spark, [(f"http://h{k}.example/{i}", f"<html><body>{b.format(i=i)}</body></html>")
                             for k, b in enumerate(bodies) for i in range(4)])
    assert got == [w.format(i=i) for w in want for i in range(4)]
    alone = read_pages(spark, [("http://one.example/", "<body><h1>Title</h1><article>Teaser</article><p>Story</p></body>")])
    assert alone == ["Title\n\nTeaser\n\nStory"]
    copies = read_pages(spark, [("http://same.example/", "<body><h1>Title</h1><div><p>Story</p></div></body>")] * 4)
    assert copies == ["Title\n\nStory"] * 4
