"""The registered queries and the pipeline over the small tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from textpace.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "op1": {"doc_id", "size", "source_size", "target", "taken"}, "op2": {"doc_id", "held_out", "lang_pred", "score"},
    "op3": {"doc_id", "item_id", "edits"}, "op4": {"doc_id", "n_words", "base_failed", "kept"},
    "op5": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op6": {"page_id", "host", "path", "rule", "verdict"}, "op7": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op8": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op9": {"doc_id", "n_shingles", "component_id"}, "op10": {"page_id", "url", "text", "n_chars"},
    "op11": {"doc_id", "held_out", "score", "predicted"}, "op12": {"item_id", "rank", "doc_id", "score"},
    "op13": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    op = name.split("_")[0]
    table = "pages" if op in ("op6", "op10") else "documents"
    assert COLUMNS[op] <= set(df.columns)
    if op not in ("op3", "op12", "op13"):
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in queries.ORACLES:
        con = duckdb.connect()
        for name_ in ("documents", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{SF}/{name_}.parquet'")
        cur = con.execute(queries.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(cur.fetchall(), key=str) == sorted((tuple(r[n] for n in names) for r in rows), key=str)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        assert after.count() <= before.count()
        before = after
    last = corpus_pipeline.run(spark, SF)
    assert last.count() == before.count() and last.where("taken > 3 * size").count() == 0
