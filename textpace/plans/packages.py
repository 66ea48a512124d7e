"""E-book and word-processor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpace.functions import words as W
from textpace.operators import blocks as B
from textpace.operators import office as O
from textpace.operators import office_xml as OX
from textpace.operators import packages as P
from textpace.plans.registry import ORACLES, query, sql_text
from textpace.sources.derived import fb2_docs, office_members, office_tables, package_members, package_tables, wide_ordinal

PAT = sql_text(W.WORD_PATTERN.replace("*+", "*"))
TRIM = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
COLLAPSE = r"regexp_replace(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
LINES = "ln AS (SELECT doc_id, lang, unnest(s) AS line, unnest(range(len(s))) AS i FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS s FROM documents))"


@query("h21_ebook_blocks", f"""
WITH {LINES}, esc AS (SELECT doc_id, i, replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e FROM ln),
t AS (SELECT doc_id, i, CASE i % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'quote' ELSE 'paragraph' END AS type,
  CASE WHEN i % 5 = 0 THEN least(6, i // 5 + 1) END AS level,
  {TRIM.format(x="replace(replace(replace(e, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')")} AS text FROM esc)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block_idx, type, level, text FROM t WHERE text <> ''
""")
def h21(spark, sf):
    return P.ebook_blocks(fb2_docs(spark, sf))


@query("h22_ebook_metadata", """
SELECT doc_id, 'Book & ' || doc_id AS title, 'F' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' ' || lang END AS author FROM documents
""")
def h22(spark, sf):
    return P.ebook_metadata(fb2_docs(spark, sf))


def _files(t):
    return P.reading_order(t["spine"], t["manifest"], t["members"])


@query("h23_package_reading_order", """
SELECT conv_id AS pkg_id, 100 - turn AS spine_idx, 'OEBPS/te xt/ch' || turn || '.xhtml' AS path FROM conversations
""")
def h23(spark, sf):
    return _files(package_tables(spark, sf)).select("pkg_id", "spine_idx", "path")


FILE_WORDS = f"""
c AS (SELECT conv_id AS pkg_id, 100 - turn AS spine_idx, 'OEBPS/te xt/ch' || turn || '.xhtml' AS path, turn,
  2 + len(regexp_extract_all('start here ' || text, {PAT}, 0)) + 1 + 1 + 2 AS n_words FROM conversations),
o AS (SELECT *, 2 + coalesce(sum(n_words) OVER (PARTITION BY pkg_id ORDER BY spine_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_word FROM c)
"""


@query("h24_file_offsets", f"WITH {FILE_WORDS} SELECT pkg_id, spine_idx, path, start_word, n_words FROM o")
def h24(spark, sf):
    t = package_tables(spark, sf)
    return P.file_offsets(_files(t), t["titles"])


@query("h25_outline_links", f"""
WITH {FILE_WORDS},
e AS (SELECT pkg_id, 0 AS source, turn * 3 + 1 AS entry_idx, 1 AS level, 'Part ' || turn AS title, start_word AS word_idx FROM o WHERE pkg_id % 3 = 0
  UNION ALL SELECT pkg_id, 0, turn * 3 + 2, 2, 'Mid ' || turn, start_word + 4 FROM o WHERE pkg_id % 3 = 0
  UNION ALL SELECT pkg_id, 0, turn * 3 + 3, 2, 'Gone ' || turn, start_word FROM o WHERE pkg_id % 3 = 0
  UNION ALL SELECT pkg_id, 1, turn * 2 + 1, 1, 'Part ' || turn, start_word FROM o WHERE pkg_id % 3 = 1
  UNION ALL SELECT pkg_id, 1, turn * 2 + 2, 2, 'End', start_word + n_words - 2 FROM o WHERE pkg_id % 3 = 1
  UNION ALL SELECT pkg_id, 2, row_number() OVER (PARTITION BY pkg_id ORDER BY spine_idx) - 1, 1, 'Chapter ' || turn, start_word FROM o WHERE pkg_id % 3 = 2)
SELECT * FROM e
""")
def h25(spark, sf):
    t = package_tables(spark, sf)
    files = _files(t)
    offsets = P.file_offsets(files, t["titles"])
    anchors = P.anchor_offsets(files, ["pkg_id", "spine_idx"])
    entries = P.nav_entries(t["navs"]).withColumn("source", F.lit(0)).unionByName(
        P.ncx_entries(t["ncxs"]).withColumn("source", F.lit(1))).withColumn("folder", F.lit("OEBPS"))
    blocks = P.xhtml_blocks(files, ["pkg_id", "spine_idx"]).select(
        "pkg_id", wide_ordinal("spine_idx", "block_idx").alias("block_idx"), "type", "level", "text")
    heads = B.heading_items(blocks, "pkg_id").join(
        t["titles"].select("pkg_id", W.word_count(F.col("title")).alias("lead")), "pkg_id").select(
        "pkg_id", "toc_idx", "level", "title", (F.col("word_idx") + F.col("lead")).alias("word_idx"))
    return P.resolve_links(entries, offsets, anchors, heads)


@query("h26_xhtml_blocks", f"""
WITH {FILE_WORDS}, b AS (SELECT pkg_id, spine_idx, turn, unnest([0, 1, 2, 3, 4]) AS block_idx FROM c)
SELECT b.pkg_id, b.spine_idx, block_idx, CASE block_idx WHEN 0 THEN 'heading' WHEN 2 THEN 'table' WHEN 3 THEN 'list' ELSE 'paragraph' END AS type,
  CASE block_idx WHEN 0 THEN 'Chapter ' || b.turn WHEN 1 THEN {COLLAPSE.format(x="'start here ' || t.text")} WHEN 2 THEN 'table' WHEN 3 THEN 'item' ELSE 'the end' END AS text
FROM b JOIN conversations t ON t.conv_id = b.pkg_id AND t.turn = b.turn
""")
def h26(spark, sf):
    return P.xhtml_blocks(_files(package_tables(spark, sf)), ["pkg_id", "spine_idx"]).select(
        "pkg_id", "spine_idx", "block_idx", "type", "text")


@query("h26_anchor_offsets", f"""
WITH {FILE_WORDS}
SELECT pkg_id, spine_idx, a AS anchor, CASE a WHEN 'top' THEN 0 WHEN 'mid' THEN 4 WHEN 'tab' THEN n_words - 4 ELSE n_words - 2 END AS "offset"
FROM c, unnest(['top', 'mid', 'tab', 'end']) AS u(a)
""")
def h26a(spark, sf):
    return P.anchor_offsets(_files(package_tables(spark, sf)), ["pkg_id", "spine_idx"])


@query("h27_navigation_entries", """
SELECT conv_id AS pkg_id, turn * 3 + k AS entry_idx, CASE WHEN k = 1 THEN 1 ELSE 2 END AS level,
  CASE k WHEN 1 THEN 'Part ' WHEN 2 THEN 'Mid ' ELSE 'Gone ' END || turn AS title,
  'te%20xt/ch' || turn || '.xhtml' || CASE k WHEN 1 THEN '#top' WHEN 2 THEN '#mid' ELSE '#none' END AS href
FROM conversations, unnest([1, 2, 3]) AS u(k) WHERE conv_id % 3 = 0
UNION ALL SELECT conv_id, turn * 2 + k, k, CASE k WHEN 1 THEN 'Part ' || turn ELSE 'End' END,
  'te%20xt/ch' || turn || '.xhtml' || CASE k WHEN 1 THEN '' ELSE '#end' END
FROM conversations, unnest([1, 2]) AS u(k) WHERE conv_id % 3 = 1
""")
def h27(spark, sf):
    t = package_tables(spark, sf)
    return P.nav_entries(t["navs"]).unionByName(P.ncx_entries(t["ncxs"]))


STYLED = f"""{LINES}, sty AS (SELECT doc_id, i, line, CASE i % 9 WHEN 0 THEN 'heading' WHEN 1 THEN 'heading' WHEN 2 THEN 'quote' WHEN 3 THEN 'list'
  WHEN 4 THEN 'heading' WHEN 5 THEN 'quote' ELSE 'paragraph' END AS type, CASE i % 9 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 4 THEN 2 END AS level FROM ln)"""


@query("h28_style_types", f"WITH {STYLED} SELECT doc_id, i AS para_idx, type, level FROM sty")
def h28(spark, sf):
    t = office_tables(spark, sf)
    return O.style_types(t["paras"], t["styles"]).select("doc_id", "para_idx", "type", "level")


@query("h29_h30_paragraph_blocks", f"""
WITH {STYLED}, k AS (SELECT doc_id, i, {COLLAPSE.format(x='line')} AS t, CASE WHEN i % 13 = 8 THEN i % 3 END AS num, type, level FROM sty),
q AS (SELECT doc_id, i, t, num, CASE WHEN num IS NULL AND type = 'heading' THEN level END AS level,
   CASE WHEN num IS NOT NULL THEN 'list' WHEN type = 'paragraph' AND i % 9 IN (6, 7) THEN 'code' ELSE type END AS type FROM k WHERE t <> ''),
r AS (SELECT *, CASE WHEN type = 'code' AND lag(type) OVER w = 'code' THEN 0 ELSE 1 END AS s FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block_idx FROM r)
SELECT doc_id, block_idx::BIGINT AS block_idx, type, any_value(level) AS level,
  CASE type WHEN 'code' THEN 'code' WHEN 'list' THEN any_value(repeat('  ', coalesce(num, 0)) || '• ' || t) ELSE any_value(t) END AS text,
  CASE WHEN type = 'code' THEN string_agg(t, chr(10) ORDER BY i) END AS payload FROM u GROUP BY doc_id, block_idx, type
""")
def h29(spark, sf):
    t = office_tables(spark, sf)
    return O.paragraph_blocks(O.style_types(t["paras"], t["styles"]), t["runs"])


@query("h31_footnote_blocks", f"""
WITH {LINES} SELECT doc_id, i::VARCHAR AS note_id, '[' || i || '] ' || {COLLAPSE.format(x='line')} AS text FROM ln
WHERE i % 4 < 2 AND i % 3 = 0 AND i > 1 AND {COLLAPSE.format(x='line')} <> ''
""")
def h31(spark, sf):
    t = office_tables(spark, sf)
    return O.footnote_blocks(t["notes"], t["refs"])


@query("h32_embedded_images", f"""
WITH {LINES} SELECT doc_id, i AS para_idx, 'rId' || i AS rel_id, 'media/image' || i || '.png' AS path FROM ln WHERE i % 10 = 0
""")
def h32(spark, sf):
    t = office_tables(spark, sf)
    return O.embedded_images(t["uses"], t["rels"], t["media"]).select("doc_id", "para_idx", "rel_id", "path")


@query("h33_table_blocks", f"""
WITH {LINES}, r AS (SELECT doc_id, i // 4 AS table_idx, i, string_split(line, ' ') AS r FROM ln),
k AS (SELECT * FROM r WHERE len(list_filter(r, lambda c: regexp_matches(c, '[^\\s\\p{{Z}}]'))) > 0),
e AS (SELECT doc_id, table_idx, i, len(r) AS n, row_number() OVER (PARTITION BY doc_id, table_idx ORDER BY i) = 1 AS head,
  list_transform(r, lambda c: replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS c FROM k)
SELECT doc_id, table_idx, max(n) AS columns, '<table><thead>' ||
  string_agg(CASE WHEN head THEN '<tr>' || array_to_string(list_transform(c, lambda x: '<th>' || x || '</th>'), '') || '</tr></thead><tbody>'
   ELSE '<tr>' || array_to_string(list_transform(c, lambda x: '<td>' || x || '</td>'), '') || '</tr>' END, '' ORDER BY i) || '</tbody></table>' AS html
FROM e GROUP BY doc_id, table_idx
""")
def h33(spark, sf):
    return O.tables(office_tables(spark, sf)["cells"])


# The same rows from stored XML members. The spine names a missing file first; an image with a
# stored file, at the end of every tenth paragraph, starts another one.
def _unpacked(members):
    documents = P.package_documents(members)
    manifest = P.manifest_items(documents)
    return documents, manifest, P.reading_order(P.spine_items(documents), manifest, members)


@query("h23_package_from_xml", """
SELECT conv_id AS pkg_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS spine_idx, 'OEBPS/te xt/ch' || turn || '.xhtml' AS path
FROM conversations
""")
def h23_xml(spark, sf):
    return _unpacked(package_members(spark, sf))[2].select("pkg_id", "spine_idx", "path")


@query("h23_package_navigation", """
SELECT DISTINCT conv_id AS pkg_id, 'Package ' || conv_id AS title, 'A & B' AS author,
  CASE conv_id % 3 WHEN 0 THEN 'nav' WHEN 1 THEN 'ncx' END AS kind, CASE WHEN conv_id % 3 < 2 THEN 'OEBPS' END AS folder
FROM conversations
""")
def h23_navigation(spark, sf):
    members = package_members(spark, sf)
    documents, manifest, _ = _unpacked(members)
    found = P.navigation_members(documents, manifest, members)
    kinds = found["navs"].select("pkg_id", "folder", F.lit("nav").alias("kind")).unionByName(
        found["ncxs"].select("pkg_id", "folder", F.lit("ncx").alias("kind")))
    return P.package_titles(documents).join(kinds, "pkg_id", "left")


@query("h28_style_types_from_xml", f"""WITH {STYLED}
SELECT doc_id, (i + (i + 9) // 10)::BIGINT AS para_idx, type, level FROM sty
""")
def h28_xml(spark, sf):
    members = office_members(spark, sf)
    return O.style_types(OX.read_body(members)["paras"], OX.styles(members)).select("doc_id", "para_idx", "type", "level")


@query("h29_h30_paragraph_blocks_from_xml", ORACLES["h29_h30_paragraph_blocks"])
def h29_xml(spark, sf):
    return O.document_blocks(OX.paragraphs(office_members(spark, sf)).where("said"))


@query("h31_footnotes_from_xml", ORACLES["h31_footnote_blocks"])
def h31_xml(spark, sf):
    t = OX.read_documents(office_members(spark, sf))
    return O.footnote_blocks(t["notes"], t["refs"])


@query("h32_images_from_xml", f"""
WITH {LINES} SELECT doc_id, (i + i // 10 + 1)::BIGINT AS para_idx, 'rId' || i AS rel_id, 'media/image' || i || '.png' AS path FROM ln WHERE i % 10 = 0
""")
def h32_xml(spark, sf):
    t = OX.read_documents(office_members(spark, sf))
    return O.embedded_images(t["uses"], t["rels"], t["media"]).select("doc_id", "para_idx", "rel_id", "path")


@query("h33_tables_from_xml", ORACLES["h33_table_blocks"])
def h33_xml(spark, sf):
    return O.document_tables(OX.tables(office_members(spark, sf)))
