"""What a scan or a query works out for a document is worked out once."""

from pyspark.sql import functions as F

from textpace.operators.ordered import running, span_bucket
from textpace.plans.catalog import QUERIES


def test_scan_reads_once_where_columns_are_dropped(spark, tmp_path):
    spark.range(100).selectExpr("id % 3 AS k", "id AS i", "'x' AS more").write.parquet(f"{tmp_path}/t")
    got = running(spark.read.parquet(f"{tmp_path}/t"), ["k"], ["i"], span_bucket("i", 8), sums={"n": F.lit(1)}).select("k", "i", "n")
    assert sorted(r["n"] for r in got.collect())[-1] == 33
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan") == 1


def test_rendered_order_parses_a_document_once(spark):
    plan = QUERIES["m20_rendered_order"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ENSURE_REQUIREMENTS" not in plan
