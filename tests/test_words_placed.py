"""Words of a page are gathered where their line was placed."""

from textpace.plans.catalog import QUERIES


def test_no_word_row_is_shuffled(spark):
    plan = QUERIES["l24_text_word_locations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
