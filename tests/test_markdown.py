"""Markdown structure on small literal documents."""

import random

from pyspark.sql import functions as F

from textpace.functions import markdown as MF
from textpace.operators import markdown as M


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")


def blocks(spark, text):
    rows = M.parse_blocks(docs(spark, text)).orderBy("block_idx").collect()
    return [(r.type, r.level, r.text, r.payload) for r in rows]


def test_blocks(spark):
    text = "\n".join([
        "# Title #", "first *line*", "second line", "[^1]: note", "third", "", "Setext", "===", "- [x] done", "2. two",
        "> quoted", "***", "plain", "---", "$$a+b$$", "---"])
    assert blocks(spark, text) == [
        ("heading", 1, "Title", None), ("paragraph", None, "first line second line third", None),
        ("heading", 1, "Setext", None), ("list", None, "done", None), ("list", None, "two", None),
        ("quote", None, "quoted", None), ("heading", 2, "plain", None), ("formula", None, "formula", "a+b")]


def test_fences_and_formulas_hide_each_other(spark):
    text = "\n".join(["```Swift", "$$", "code", "```", "$$", "x", "```", "$$", "tail", "$$", "~~~", "open"])
    assert blocks(spark, text) == [
        ("code", None, "code", "$$\ncode"), ("formula", None, "formula", "x\n```"),
        ("paragraph", None, "tail", None), ("paragraph", None, "$$", None), ("code", None, "code", "open")]


def test_tables(spark):
    text = "\n".join(["a | b", "--- | ---", "1 | x\\|y | 3", "2", "", "h | i", "--- | --- | ---", "one | two", "|c|", "---", "r | s"])
    got = blocks(spark, text)
    assert got[0] == ("table", None, "table", "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody>"
                      "<tr><td>1</td><td>x|y</td></tr></tbody></table>")
    assert got[1] == ("paragraph", None, "2", None)
    # Unequal cell counts: prose; a one-column header may use a bare rule as separator.
    assert got[2] == ("paragraph", None, "h | i --- | --- | --- one | two", None)
    assert got[3][3] == "<table><thead><tr><th>c</th></tr></thead><tbody><tr><td>r</td></tr></tbody></table>"


def test_scanned_text_collapses_tables(spark):
    text = "# A\n| h | i |\n| - | - |\n| 1 | 2 |\n* item\n```\n| x | y |\n"
    assert M.scanned_plain_text(docs(spark, text)).first().plain_text == "A\ntable\nitem\nx y"


def test_formulas_and_prices(spark):
    text = "$5 to $10, $x^2$ \\(a\\) `$no$` \\$1$ $$\nbig\n$$ \\[c\\]\n```\n$in$\n```\n$a $ b$"
    rows = M.formulas(docs(spark, text)).orderBy("formula_idx").collect()
    assert [(r.latex, r.display) for r in rows] == [("x^2", False), ("a", False), ("\nbig\n", True), ("c", True)]


def test_abbreviations_longest_first_outside_code(spark):
    text = "*[HTML]: Hyper\n*[HTML 5]: Five\n*[HTML]: Hyper Text\nHTML 5 and HTML, xHTMLx `HTML`\n```\n*[CSS]: no\nHTML\n```"
    rows = M.abbreviations(docs(spark, text)).orderBy("use_idx").collect()
    assert [(r.term, r.expansion) for r in rows] == [("HTML 5", "Five"), ("HTML", "Hyper Text")]


def test_definition_lists(spark):
    text = "\n".join(["para", "Term", "", ": one", "more", ": two", "", ": orphan", "Next", ": three", "# x", "    in", "Last", ":no"])
    rows = M.definition_lists(docs(spark, text)).orderBy("def_line").collect()
    assert [(r.term, r.definition) for r in rows] == [
        ("Term", "one more"), ("Term", "two"), ("Next", "three # x")]


def test_footnotes_number_by_first_use(spark):
    text = "a[^b] c[^a] d[^b] e[^none] `[^a]`\n[^a]: first\n[^b]: second"
    rows = M.footnotes(docs(spark, text)).orderBy("ref_idx").collect()
    assert [(r.label, r.number, r.content) for r in rows] == [("b", 1, "second"), ("a", 2, "first"), ("b", 1, "second")]


def test_inline_rules(spark):
    df = docs(spark, "x")
    got = df.select(
        MF.strip_extensions(MF.strip_inline(F.lit("H~2~O 19^th^ ++in s++ ==m== ~~gone~~ a ~ b ++ x++"))).alias("a"),
        MF.typography(F.lit("(c) +- ... -- --- `--`\n| --- |")).alias("b"),
        MF.emoji(F.lit(":smile: :nope: :+1:")).alias("c")).first()
    assert tuple(got) == ("H2O 19th in s m gone a ~ b ++ x++", "© ± … – — `--`\n| --- |", "😄 :nope: 👍")


def test_containers(spark):
    rows = M.containers(docs(spark, "::: warn \nbody\nmore\n:::\ntext\n:::note\nb\n:::")).orderBy("container_idx").collect()
    assert [(r.name, r.content) for r in rows] == [("warn", "body\nmore"), ("note", "b")]


def test_emoji_names_are_all_there(spark):
    assert len(MF.EMOJI) == 124


def test_lone_formula_mark_ends_a_paragraph(spark):
    assert blocks(spark, "a\n$$\nb") == [("paragraph", None, "a", None), ("paragraph", None, "$$ b", None)]


def plain_roles(lines):
    """The delimiter automaton line by line."""
    mode, roles = 0, []
    last = max((i for i, l in enumerate(lines) if l.strip() == "$$"), default=-1)
    for i, line in enumerate(lines):
        fence, dollars, role = line.strip()[:3] in ("```", "~~~"), line.strip() == "$$", None
        if fence and mode < 2:
            role, mode = ("fence_close", 0) if mode else ("fence_open", 1)
        elif dollars and mode == 2:
            role, mode = "math_close", 0
        elif dollars and mode == 0 and i < last:
            role, mode = "math_open", 2
        roles.append(role)
    return roles


def plain_tables(row, head):
    """Headers accepted in order; each table runs to the last pipe line after its separator."""
    at, end = [None] * len(row), -1
    for i, is_head in enumerate(head):
        if is_head and i > end:
            end = i + 1
            while end + 1 < len(row) and row[end + 1]:
                end += 1
            at[i:end + 1] = [i] * (end + 1 - i)
    return at


def test_delimiter_scan_equals_a_plain_automaton(spark):
    rng = random.Random(7)
    texts = [[rng.choice(["```", "~~~x", "$$", " $$ ", "a", ""]) for _ in range(n)] for n in (0, 1, 2, 5, 63, 64, 65, 129, 400, 900)]
    rows = docs(spark, *["\n".join(t) for t in texts]).select(
        "doc_id", M._line_roles(F.split("text", "\n")).alias("r")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.r == plain_roles("\n".join(texts[r.doc_id]).split("\n"))


def test_table_lines_equal_headers_accepted_in_order(spark):
    rng = random.Random(3)
    want, rows = {}, []
    for doc in range(60):
        row = [rng.random() < 0.6 for _ in range(40)]
        head = [r and i < 39 and rng.random() < 0.5 for i, r in enumerate(row)]
        want[doc] = plain_tables(row, head)
        rows += [(doc, i, *x) for i, x in enumerate(zip(row, head))]
    lines = spark.createDataFrame(rows, "doc_id INT, line_idx INT, row BOOLEAN, head BOOLEAN")
    got = {d: [None] * 40 for d in want}
    for r in M._with_tables(lines, "doc_id").collect():
        assert r.in_table == (r.table_at is not None)
        got[r.doc_id][r.line_idx] = r.table_at
    assert got == want


def test_block_text_is_worked_out_once(spark):
    """The filter on empty blocks reads the text; it does not repeat the rules that make it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = M.parse_blocks(docs).where("type = 'list'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[ xX]") == 1
