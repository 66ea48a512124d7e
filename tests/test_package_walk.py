"""The body of a document is walked once, and only what is kept becomes a row."""

from pyspark.sql import functions as F

from textpace.functions import xml as X
from textpace.operators import office_xml as OX
from textpace.sources.derived import office_members


def body(spark, text):
    return spark.createDataFrame([(1, OX.BODY, text)], "doc_id INT, path STRING, content STRING")


def test_tokens_of_tables_are_no_rows(spark):
    cells = "<w:tc><w:p><w:r><w:t>word</w:t></w:r></w:p></w:tc>" * 50
    table = f"<w:tbl><!-- </w:tbl> --><w:tr><w:tc><w:TBL><w:tr>{cells}</w:tr></w:TBL></w:tc></w:tr></w:tbl>"
    text = f"<w:document><w:body><w:p><w:r><w:t>a</w:t></w:r></w:p>{table}<w:tbl/><w:p><w:r><w:t>b</w:t></w:r></w:p></w:body></w:document>"
    rows = OX._parts(body(spark, text)).where("in_text").select("tok", "para_idx", "run_idx").orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [("a", 0, 1), ("b", 1, 1)]
    # Of the run outside tables, its tag and its text.
    assert OX._parts(body(spark, text)).count() == 4
    assert OX._cells(body(spark, text)).groupBy("table_idx").count().orderBy("table_idx").collect() == [(0, 1), (1, 50)]


def test_walk_reads_as_the_columns_do(spark):
    texts = ["a &amp; b", "&#0; &#xD800; &#x110000; &#128512; &amp;lt; &nbsp; &", "<![CDATA[<z>&amp;]]>", "x &#x41;&quot;"]
    tags = ["<a:B x='1>2' n:embed=\"&#x41;&quot;\"/>", "<blip embed = 'r1'>", "<blip embed='no'>", "<blip xembed='no'>"]
    df = spark.createDataFrame([(t, g) for t, g in zip(texts, tags)], "t STRING, g STRING")
    rows = df.select("t", "g", X.text_of(F.col("t")).alias("text"), X.attribute(F.col("g"), "embed").alias("a"),
                     X.local_name(F.col("g")).alias("name")).collect()
    assert [X.text_in(r.t) for r in rows] == [r.text for r in rows]
    assert [X.attribute_of(r.g, "embed") for r in rows] == [r.a for r in rows]
    assert [X.named(r.g)[0] for r in rows] == [r.name for r in rows]


def test_reader_of_one_member_makes_no_other(spark):
    plan = office_members(spark, "/root/testdata/sf0.001").where(F.col("path") == OX.RELATIONS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relationship" in plan and "w:tbl" not in plan and "w:footnote " not in plan
