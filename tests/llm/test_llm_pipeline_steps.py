"""Steps of the pipeline do once what they did several times, with the same results."""

import numpy as np
from pyspark.sql import functions as F

from textpace.llm import privacy, shingle_join


def test_sanitise_searches_a_text_once(spark):
    docs = spark.createDataFrame(
        [(1, "write to a.b@c.org now", 22), (2, "nothing", 7), (3, None, None)], "doc_id INT, text STRING, n_chars INT")
    done = privacy.sanitise(docs)
    assert "@[A-Za-z0-9-]" not in done._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, done.collect())) == [(1, "write to <email> now", 20), (2, "nothing", 7), (3, None, None)]


def test_places_equal_a_loop(spark):
    df = spark.createDataFrame([("12 a 3",), ("",), ("x",), ("é7",), ("78",)], "t STRING")
    got = [[tuple(p) for p in r[0]] for r in df.select(privacy.places(F.col("t"), "[0-9]+")).collect()]
    assert got == [[(0, 2, "12"), (5, 6, "3")], [], [], [(1, 2, "7")], [(0, 2, "78")]]


def test_shingles_are_the_same_for_many_texts_as_for_few():
    texts = [f"w{i % 50} of a text w{i % 7}".encode() for i in range((1 << 15) + 5)]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    hashed, begin = shingle_join.shingles(data, offsets)
    few, at = shingle_join.shingles(data[:offsets[300]], offsets[:301])
    assert (hashed[:len(few)] == few).all() and (begin[:301] == at).all()
    assert (np.diff(few.reshape(-1)) > 0).sum() >= len(few) - 300


def test_powers_equal_repeated_products():
    want, value = [], 1
    for _ in range(1000):
        want.append(value)
        value = value * 0xD1342543DE82EF95 % (1 << 64)
    for n in (0, 1, 2, 3, 1000):
        assert shingle_join._powers(0xD1342543DE82EF95, n).tolist() == want[:n]
