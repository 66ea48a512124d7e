"""Language identification sends only text to Python, judges it once, and counts what the plain rules count."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from textpace.llm import langid

TEXTS = ["", "a", "ab", "Straße, 12 Zeilen", "abcab" * 300, "\x00é", "x", "the cat. THE CAT"]


def plain(text: bytes) -> Counter:
    """Features of one text by the definition: letters in lower case, any other ASCII byte a space."""
    at = [b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in text]
    found = Counter()
    for i, order in enumerate(langid.ORDERS):
        for j in range(len(at) - order + 1):
            gram = 0
            for b in at[j:j + order]:
                gram = gram * 257 + b
            found[i * langid.TABLE + (gram * 0x9E3779B1 >> 12) % langid.TABLE] += 1
    return found


def test_counts_are_those_of_each_row():
    raw = [t.encode() for t in TEXTS]
    row, feature, n = langid.counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(t) for t in raw]))
    got = [Counter() for _ in raw]
    for r, f, c in zip(row.tolist(), feature.tolist(), n.tolist()):
        got[r][f] = c
    assert got == [plain(t) for t in raw]


def test_no_row_of_the_counts_is_stored_for_features_a_text_lacks():
    row, _, _ = langid.counts(np.frombuffer(b"ab", np.uint8), np.array([0, 2]))
    assert len(row) == 1


def test_a_filter_judges_once_and_text_stays_in_spark(spark):
    docs = spark.createDataFrame([(1, "the cat", "en"), (2, "der Hund", "de")], "doc_id INT, text STRING, lang STRING")
    df = langid.predict(docs, langid.fit(docs)).where(F.col("lang_pred") != "und").select("doc_id", "lang_pred")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
    assert sorted(map(tuple, df.collect())) == [(1, "en"), (2, "de")]
