"""Tables and paragraphs of a body are put together in its walk, not by shuffles of their cells and tokens."""

from textpace.functions import xml as X
from textpace.operators import office as O
from textpace.operators import office_xml as OX
from textpace.plans.catalog import QUERIES

CELL = "<w:tc><w:tcPr/><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"


def plan_of(spark, name):
    return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_no_cell_of_xml_is_shuffled(spark):
    plan = plan_of(spark, "h33_tables_from_xml")
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_paragraphs_are_walked_once_and_move_once(spark):
    plan = plan_of(spark, "h29_h30_paragraph_blocks_from_xml")
    assert plan.count("ArrowEvalPython [_body_paragraphs") == 1
    moved = plan.split("ArrowEvalPython [_body_paragraphs")[0]
    assert moved.count("ENSURE_REQUIREMENTS") == 1


def test_a_cell_of_one_text_is_one_piece():
    assert X.cell_pieces("<tbl>" + CELL.format("a &lt; b") * 2 + "</tbl>") == [
        ("", "<tbl>"), ("a &lt; b", ""), ("a &lt; b", ""), ("", "</tbl>"), ("", "")]


def test_cells_of_one_text_and_others(spark):
    nested = f"<w:tc><w:p/><w:tbl><w:tr>{CELL.format('in')}</w:tr></w:tbl>{CELL.format('odd')}<w:p><w:t>out<!-- </w:t> --></w:t><w:br/></w:p></w:tc>"
    text = f"<w:body>{CELL.format('no table')}<w:tbl><w:tr>{CELL.format('a &amp; b')}{nested}</w:tr><w:tr><w:tc/></w:tr></w:tbl></w:body>"
    assert OX._tables(text) == [
        (0, [(0, [(0, " a & b"), (1, " "), (2, " odd out ")]), (1, [(0, "")])]), (1, [(0, [(0, " in")])])]
    members = spark.createDataFrame([(1, OX.BODY, text)], "doc_id INT, path STRING, content STRING")
    nested_rows = sorted(map(tuple, O.document_tables(OX.tables(members)).collect()))
    assert nested_rows == sorted(map(tuple, O.tables(OX.read_body(members)["cells"]).collect()))


def test_blocks_of_whole_documents_equal_those_of_rows(spark):
    code = '<w:rPr><w:rFonts w:ascii=" Consolas" w:cs="Menlo"/></w:rPr>'
    body = "".join([
        '<w:p><w:pPr><w:pStyle w:val="S1"/></w:pPr><w:r><w:t>head</w:t></w:r></w:p>',
        f"<w:p><w:r>{code}<w:t>x</w:t><w:tab/></w:r><w:r>{code}<w:t>y</w:t></w:r></w:p>", "<w:p><w:r></w:r></w:p>",
        f"<w:p><w:r>{code}<w:t>z</w:t></w:r><w:r><w:t> </w:t></w:r></w:p>",
        '<w:p><w:pPr><w:numPr><w:ilvl w:val="x"/><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>a &amp; b</w:t><w:br/></w:r></w:p>',
        f'<w:p><w:pPr><w:numPr/></w:pPr><w:r>{code}<w:t>c</w:t></w:r></w:p>', "<w:p><w:t>no run</w:t></w:p>"])
    styles = "<w:styles><w:style w:styleId='S1'><w:name w:val='Heading 3'/></w:style></w:styles>"
    members = spark.createDataFrame(
        [(d, p, c) for d in (1, None) for p, c in ((OX.BODY, f"<w:body>{body}</w:body>"), (OX.STYLES, styles))],
        "doc_id INT, path STRING, content STRING").where("doc_id IS NOT NULL OR path = 'word/document.xml'")
    got = O.document_blocks(OX.paragraphs(members).where("said"))
    t = OX.read_documents(members)
    want = O.paragraph_blocks(O.style_types(t["paras"], t["styles"]), t["runs"])
    rows = sorted(map(tuple, got.where("doc_id = 1").collect()))
    assert rows == sorted(map(tuple, want.where("doc_id = 1").collect()))
    assert [(r[2], r[3], r[4], r[5]) for r in rows] == [
        ("heading", 3, "head", None), ("code", None, "code", "x y\nz"), ("list", None, "  • a & b", None), ("list", None, "• c", None)]
