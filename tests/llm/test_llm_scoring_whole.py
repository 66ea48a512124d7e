"""Language-model scores where training shows more strings than a task may hold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textpace.llm import scoring


@pytest.mark.parametrize("most", [0, 40])
def test_no_string_is_left_out(spark, monkeypatch, most):
    rng = random.Random(11)
    bits = ["the ", "reader ", "ément", "Ωx", "12.5 ", "\n", "zq", " ", "ing ", "\U0001F600"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(60, None), (61, ""), (61, "unseen 中文 中文"), (None, "the reader")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn(
        "held_out", F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False)))

    def scores():
        got = scoring.score(docs, docs.where(~F.col("held_out"))).collect()
        return sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.score) for r in got)

    whole = scores()
    monkeypatch.setattr(scoring, "MAX_NODES", most)
    joined = scores()
    assert [r[:4] for r in joined] == [r[:4] for r in whole] and len(joined) == len(rows)
    assert all(math.isclose(a[4], b[4], rel_tol=1e-12) for a, b in zip(joined, whole))
