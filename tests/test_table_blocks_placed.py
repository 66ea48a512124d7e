"""Cells of word-processor tables are grouped where their document was placed."""

from textpace.plans.catalog import QUERIES


def test_no_cell_is_shuffled(spark):
    plan = QUERIES["h33_table_blocks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
