"""Markdown queries against their SQL where document lines are themselves headers of tables."""

import duckdb
import pytest

from textpace.plans import catalog


def document(tail, lines=24):
    """Line 21 is followed by a line of three dashes."""
    return "\n".join([f"line {i}" for i in range(21)] + [tail] + [f"rest {i}" for i in range(lines - 22)])


TEXTS = [
    document("one |"),             # one cell, as the separator: a table
    document("| one"),
    document("one | two"),         # two cells: still a heading
    document("|"),                 # no cell
    document("one |", 22),         # at the end of the document
    document("plain", 23),
    "\n".join(["a | b", "c |", "| d", "", "|", "e |"] * 8),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id LONG, text STRING").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["m4_m5_headings", "m11_m12_tables", "m20_rendered_order"])
def test_lines_that_open_tables(spark, folder, name):
    df = catalog.QUERIES[name](spark, folder)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        want = con.execute(catalog.ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        order = lambda r: [str(v) for v in r]
        got = sorted((tuple(r) for r in df.select(*columns).collect()), key=order)
        assert got == sorted(want.fetchall(), key=order)
    if name == "m11_m12_tables":
        assert [r.payload for r in df.where("doc_id = 0 AND columns = 1").collect()] == [
            "<table><thead><tr><th>one</th></tr></thead><tbody></tbody></table>"]
