"""Items below the length that earns an edit budget."""

import random
import re

from textpace.llm import decontamination as D


def test_short_items_match_as_whole_words(spark):
    """An exact copy of a short question is found, inside other words it is not."""
    items = [(1, "What is the capital of France?"), (2, "art"), (3, "  ... "), (4, "7 x 8"), (5, "art")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "Quiz: what is the capital of  FRANCE"), (2, "what is the capital of france s north"), (3, "what is the capitals of France"),
            (4, "a start, an artist"), (5, "Art"), (6, "such art!"), (7, "is 7 x 8 or 17 x 8"), (8, "17 x 81"), (9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["edits"], r["end_at"] - r["start_at"]) for r in D.matches(docs, bench).collect()}
    assert got == {(1, 1): (0, 29), (2, 1): (0, 29), **{(d, i): (0, 3) for d in (5, 6) for i in (2, 5)}, (7, 4): (0, 5)}
    assert sorted(r["doc_id"] for r in D.clean(docs, bench).collect()) == [3, 4, 8, 9, 10]


def test_short_items_against_patterns():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices("ab ", k=rng.randint(0, 60)))
        items = [(i, "".join(rng.choices("ab ", k=rng.randint(1, 8)))) for i in range(5)]
        got = {i for i, edits, a, b in D.Items(items, D.EDIT_RATE).find(D.plain(text))}
        assert got == {i for i, t in items if D.plain(t) and re.search(rf"(?<!\S){D.plain(t)}(?!\S)", D.plain(text))}
