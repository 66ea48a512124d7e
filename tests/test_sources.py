"""The layout contract and the session defaults."""

import pytest
from pyspark.sql import functions as F

from textpace.session import is_local, settings
from textpace.sources.files import LAYOUT, check_layout

GOOD = dict(doc_id=1, page="2", line_idx=0, text="x", x_min=0.0, x_max=9.0, y_min=0.0, y_max=5.0, font_size="11.5", bold=True)
SCHEMA = ("doc_id LONG, page STRING, line_idx INT, text STRING, x_min DOUBLE, x_max DOUBLE, y_min DOUBLE, y_max DOUBLE, "
          "font_size STRING, bold BOOLEAN")


def test_layout_rows_are_typed_or_rejected_with_a_reason(spark):
    faults = [({}, None), ({"page": "x"}, "bad page"), ({"page": "99999999999"}, "bad page"), ({"page": None}, "no page"),
              ({"doc_id": None}, "no document"), ({"line_idx": None}, "no line"), ({"text": None}, "no text"), ({"text": ""}, None),
              ({"x_max": None}, "no box"), ({"y_min": float("inf")}, "box not finite"), ({"x_min": 10.0}, "box turned over"),
              ({"font_size": "0"}, "no font size"), ({"font_size": "big"}, "bad font_size"), ({"bold": None}, None)]
    rows = [tuple((GOOD | {"doc_id": i} | f).values()) for i, (f, _) in enumerate(faults)]
    good, bad = check_layout(spark.createDataFrame(rows, SCHEMA))
    assert dict(good.dtypes) == LAYOUT | {"bold": "boolean"}
    assert sorted(r.doc_id for r in good.collect()) == [i for i, (_, why) in enumerate(faults) if why is None]
    assert sorted(r.reason for r in bad.collect()) == sorted(why for _, why in faults if why)


def test_layout_without_a_column_is_refused(spark):
    rows = spark.createDataFrame([tuple(GOOD.values())], SCHEMA)
    with pytest.raises(ValueError, match="y_max"):
        check_layout(rows.drop("y_max"))
    with pytest.raises(ValueError, match="text"):
        check_layout(rows.withColumn("text", F.array("text")))


def test_given_settings_win():
    given = {"spark.master": "yarn", "spark.sql.shuffle.partitions": "4000", "spark.sql.session.timeZone": "Europe/Paris"}
    added = settings(given, 8)
    assert not set(added) & set(given)
    # Nothing that suits one machine reaches a cluster.
    assert not {"spark.master", "spark.sql.shuffle.partitions", "spark.textpace.scanTasks", "spark.driver.memory"} & set(added)
    local = settings({"spark.sql.shuffle.partitions": "77"}, 4)
    assert local["spark.master"] == "local[4]" and "spark.sql.shuffle.partitions" not in local and local["spark.textpace.scanTasks"] == "4"
    assert is_local("local[*]") and is_local("local") and not is_local("local-cluster[2,1,1024]")
