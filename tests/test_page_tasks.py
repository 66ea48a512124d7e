"""Tokens of pages stay where their page was placed, in tasks whose number follows the input."""

from textpace.operators import markup as K
from textpace.operators import ordered as R


def test_blocks_join_and_move_no_token_rows(spark):
    pages = spark.createDataFrame([(1, "<body><div>a</div><div>b <b>c</b> d</div><h2>e</h2></body>")], "page_id INT, html STRING")
    df = K.blocks(pages)
    assert [tuple(r) for r in df.select("type", "text").orderBy("block_idx").collect()] == [
        ("paragraph", "a"), ("paragraph", "b c d"), ("heading", "e")]
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
    moved = df._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in moved


def test_tasks_follow_the_input_files(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id", "cast(id AS string) AS text").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    size = R.input_bytes(df)
    assert size > 1000 and R.input_bytes(spark.range(3)) == 0
    few = R.by_key(df, "id").rdd.getNumPartitions()
    monkeypatch.setattr(R, "TASK_BYTES", size // 999)
    assert few == R.FINE * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert R.by_key(df, "id").rdd.getNumPartitions() >= 999
