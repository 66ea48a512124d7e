"""A reader of XML members explodes the tokens it looks at and no others."""

from textpace.operators import office_xml as OX


def test_only_wanted_tokens_become_rows(spark):
    cells = "<w:tc><w:p><w:r><w:t>word</w:t></w:r></w:p></w:tc>" * 50
    text = ("<w:document><w:body><!-- <w:footnoteReference w:id='9'/> --><w:p><w:r><w:FootnoteReference w:id='2'/></w:r></w:p>"
            f"<w:tbl><w:tr>{cells}</w:tr></w:tbl><w:p x='<w:footnoteReference/>'/></w:body></w:document>")
    members = spark.createDataFrame([(1, OX.BODY, text)], "doc_id INT, path STRING, content STRING")
    rows = OX._tags(members, OX.BODY, "body", "footnotereference").select("name", "closes").collect()
    assert [tuple(r) for r in rows] == [("body", False), ("footnotereference", False), ("body", True)]
    assert [tuple(r) for r in OX.read_body(members)["refs"].collect()] == [(1, "2")]
    assert OX.read_body(members)["cells"].count() == 50
