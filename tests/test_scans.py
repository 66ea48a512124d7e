"""Split scans equal plain windows; outlines equal a stack; merges equal a loop."""

import random

from pyspark.sql import Window, functions as F

from textpace.operators import blocks as B
from textpace.operators import layout as L
from textpace.operators.ordered import following, running, scan, span_bucket, with_time_span


def test_running_equals_window(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, 1, 2, 5])) for k in "ab" for i in range(700)]
    df = spark.createDataFrame(rows, "k STRING, i INT, v INT")
    for inclusive in (False, True):
        got = running(df, ["k"], ["i"], span_bucket("i", 16), sums={"s": F.coalesce("v", F.lit(0))},
                      lasts={"l": F.col("v")}, inclusive=inclusive)
        w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        want = df.select("k", "i", "v", F.coalesce(F.sum(F.coalesce("v", F.lit(0))).over(w), F.lit(0)).alias("s"),
                         F.last("v", ignorenulls=True).over(w).alias("l"))
        assert sorted(map(tuple, got.select("k", "i", "v", "s", "l").collect()), key=str) == sorted(
            map(tuple, want.collect()), key=str)


def test_following_equals_lead(spark):
    df = spark.createDataFrame([(k, i, f"{k}{i}") for k in "ab" for i in range(0, 300, 3)], "k STRING, i INT, v STRING")
    got = following(df, ["k"], ["i"], span_bucket("i", 32), {"n": F.col("v")})
    want = df.withColumn("n", F.lead("v").over(Window.partitionBy("k").orderBy("i")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_null_keys_and_ordinals_are_kept(spark):
    rng = random.Random(4)
    rows = [(k, j, i if i % 5 else None, rng.choice([None, 1, 2])) for k in ("a", None) for j in (None, 1) for i in range(1, 90)]
    df = spark.createDataFrame(rows, "k STRING, j INT, i INT, v INT").withColumn("n", F.monotonically_increasing_id()).cache()
    got = scan(df, ["k", "j"], ["i", "n"], span_bucket("i", 16), {"s": F.coalesce("v", F.lit(0))}, {"l": F.col("v")},
               {"x": F.col("n")})
    w = Window.partitionBy("k", "j").orderBy("i", "n")
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.coalesce(F.sum(F.coalesce("v", F.lit(0))).over(back), F.lit(0)).alias("s"),
                     F.last("v", ignorenulls=True).over(back).alias("l"), F.lead("n").over(w).alias("x"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_merge_keeps_blocks_without_document_or_page(spark):
    rows = [(None, 1, 0, "paragraph", "No end"), (None, 2, 0, "paragraph", "of it."), (1, None, 0, "paragraph", "Alone"),
            (1, 1, 0, "paragraph", "Whole."), (1, 2, 0, "heading", "Title")]
    got = L.merge_across_pages(spark.createDataFrame(rows, "doc_id INT, page INT, order_idx INT, type STRING, text STRING"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        (None, 1, 0, "paragraph", "No end of it.", 2), (1, None, 0, "paragraph", "Alone", 1),
        (1, 1, 0, "paragraph", "Whole.", 1), (1, 2, 0, "heading", "Title", 1)], key=str)


def stack_parents(levels):
    stack, out = [], []
    for i, level in enumerate(levels):
        while stack and stack[-1][1] >= level:
            stack.pop()
        out.append((stack[-1][0] if stack else None, len(stack) + 1))
        stack.append((i, level))
    return out


def test_nest_equals_stack(spark):
    rng = random.Random(2)
    docs = {d: [rng.randint(1, 6) for _ in range(120)] for d in range(4)}
    rows = [(d, i, lv) for d, ls in docs.items() for i, lv in enumerate(ls)]
    got = B.nest(spark.createDataFrame(rows, "doc_id INT, toc_idx INT, level INT"))
    have = {(r.doc_id, r.toc_idx): (r.parent_idx, r.depth) for r in got.collect()}
    assert have == {(d, i): p for d, ls in docs.items() for i, p in enumerate(stack_parents(ls))}


def test_nest_reads_deep_levels(spark):
    rows = [(1, i, lv) for i, lv in enumerate([1, 9, 12, 10, 0, 2])]
    got = B.nest(spark.createDataFrame(rows, "doc_id INT, toc_idx INT, level INT"), max_level=None)
    assert {r.toc_idx: r.parent_idx for r in got.collect()} == {0: None, 1: 0, 2: 1, 3: 1, 5: 0}


def loop_merge(blocks):
    out, i = [], 0
    while i < len(blocks):
        page, kind, text = blocks[i]
        i += 1
        parts = 1
        while kind == "paragraph" and i < len(blocks):
            p, k, t = blocks[i]
            if not (p == page + 1 and k == "paragraph" and text[-1] not in ".!?:;" and t[0].islower()):
                break
            text = text[:-1] + t if text.endswith("-") else text + " " + t
            parts += 1
            i += 1
        out.append((kind, text, parts))
    return out


def test_merge_across_pages_equals_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for d in range(60):
        blocks = []
        for page in range(1, 9):
            if rng.random() < 0.1:
                continue
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                kind = "paragraph" if rng.random() < 0.9 else "heading"
                text = rng.choice("aaab" "A") + f"w{len(blocks)}" + rng.choice(["", "", "", "-", "."])
                blocks.append((page, kind, text))
        counters = {}
        for page, kind, text in blocks:
            counters[page] = counters.get(page, -1) + 1
            rows.append((d, page, counters[page], kind, text))
        want[d] = loop_merge(blocks)
    got = L.merge_across_pages(spark.createDataFrame(rows, "doc_id INT, page INT, order_idx INT, type STRING, text STRING"))
    have = {}
    for r in got.orderBy("doc_id", "page", "order_idx").collect():
        have.setdefault(r.doc_id, []).append((r.type, r.text, r.n_parts))
    assert have == {d: w for d, w in want.items() if w}


def test_union_guard_keeps_rows_single(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(100)], "k INT, v INT").repartition(4, "k")
    from textpace.operators.ordered import by_key
    both = by_key(df, "k").unionByName(by_key(df, "k"))
    counts = both.groupBy("k").agg(F.count("*").alias("n"))
    assert counts.count() == 5 and both.join(counts, "k").count() == 200


def test_scan_reads_its_input_once(spark, tmp_path):
    spark.range(100).selectExpr("id % 7 AS k", "id AS o", "'x' AS t").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    out = running(rows, ["k"], ["o"], span_bucket("o", 8), sums={"n": F.lit(1)})
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Scan parquet") == 1


def test_busy_hours_are_split_by_second(spark):
    # Two thirds of all rows are one user's in one hour; users, times and ids may be null or equal.
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 > 0, 7).when(F.col("id") % 5 > 0, F.col("id") % 4).alias("user_id"),
        F.when(F.col("id") % 1000 != 1, F.timestamp_seconds(F.when(F.col("id") % 3 > 0, F.col("id") * 37 % 3600).otherwise(F.col("id") * 60))).alias("ts"),
        F.col("id"), (F.col("id") % 7).alias("v"))
    spans = with_time_span(df, ["user_id"], "ts", "b", limit=100)
    sizes = spans.groupBy("user_id", "b").count()
    assert sizes.agg(F.max("count")).first()[0] <= 100
    assert sizes.where("user_id = 7 AND b.second IS NOT NULL").count() > 1000
    got = scan(spans, ["user_id"], ["ts", "id"], F.col("b"), {"s": F.col("v")}, {"l": F.col("v")}, {"x": F.col("id")}).drop("b")
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.coalesce(F.sum("v").over(back), F.lit(0)).alias("s"), F.last("v").over(back).alias("l"), F.lead("id").over(w).alias("x"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_rows_to_be_exploded_are_placed_in_many_tasks(spark):
    from textpace.operators.ordered import FINE, by_key
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = by_key(spark.range(5000).withColumnRenamed("id", "doc_id"), "doc_id")
    sizes = [len(p) for p in df.rdd.glom().collect()]
    # Not joined up by adaptive execution, however small the compact rows are.
    assert len(sizes) == FINE * n and sum(sizes) == 5000 and max(sizes) < 2 * 5000 / len(sizes) + 30


def test_hit_states_find_words_once(spark):
    """Exploding a plain column adds a filter on its size, for which all words were found a second time."""
    from textpace.operators.search import hit_states
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(2, "doc_id")
    plan = hit_states(docs, "tion")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    few = spark.createDataFrame([(1, "a nation, an option"), (2, None), (3, "")], "doc_id INT, text STRING")
    states = lambda *a: [(r.word_idx, r.state) for r in hit_states(few, *a).orderBy("word_idx").collect()]
    assert states("Tion") == [(0, "none"), (1, "active"), (2, "none"), (3, "hit")]
    assert states("tion", 1) == [(0, "none"), (1, "hit"), (2, "none"), (3, "active")]
    assert states("") == [(i, "none") for i in range(4)]
