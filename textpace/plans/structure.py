"""Block, outline and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpace.functions import words as W
from textpace.operators import blocks as B
from textpace.operators import search as S
from textpace.operators.search_index import WordIndex
from textpace.plans.inputs_sql import CONV_BLOCKS, POSITIONS, RICH_BLOCKS
from textpace.plans.registry import query, sql_text
from textpace.sources.derived import conv_blocks, para_docs, positions, rich_blocks
from textpace.session import shared_dir
from textpace.sources.tables import table

PAT = sql_text(W.WORD_PATTERN.replace("*+", "*"))
TRIM = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
# Twenty literal queries: plain, mixed case, metacharacters, empty, without matches.
TERMS = ["the", "Tion", "ing", "keit", "ÉON", "ment", "ado", "st.", "e,", "(", "$", "", "zzzzq",
         "Sch", "a", "que", "-", "...", "[x]", "un"]
TERM_SQL = "terms AS (SELECT unnest(range({n})) AS query_id, unnest([{l}]) AS q)".format(
    n=len(TERMS), l=", ".join(sql_text(t) for t in TERMS))

OFFSETS = f"""
counted AS (SELECT *, len(regexp_extract_all(text, {PAT}, 0)) AS n_words FROM {{src}}),
offs AS (SELECT *, coalesce(sum(n_words) OVER (PARTITION BY doc_id ORDER BY block_idx
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS word_offset FROM counted)
"""
TOC = f"""{CONV_BLOCKS}, {OFFSETS.replace('{src}', 'conv_blocks')},
items AS (SELECT doc_id, block_idx, level, text AS title, word_offset AS word_idx,
   row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) - 1 AS toc_idx FROM offs WHERE type = 'heading'),
toc AS (SELECT i.*, (SELECT max(p.toc_idx) FROM items p
   WHERE p.doc_id = i.doc_id AND p.toc_idx < i.toc_idx AND p.level < i.level) AS parent_idx FROM items i)
"""
RICH_TOC = TOC.replace(CONV_BLOCKS, RICH_BLOCKS).replace("FROM conv_blocks)", "FROM rich_blocks)")


@query("b1_split_blocks", f"""
WITH p AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS s FROM documents),
k AS (SELECT doc_id, list_filter(list_transform(s, lambda x: {TRIM.format(x='x')}), lambda x: x <> '') AS s FROM p)
SELECT doc_id, unnest(range(len(s))) AS block_idx, unnest(s) AS text, 'paragraph' AS type FROM k
""")
def b1(spark, sf):
    return B.split_blocks(para_docs(spark, sf))


@query("b2_plain_text", f"""
WITH {RICH_BLOCKS}
SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY block_idx) AS plain_text FROM rich_blocks GROUP BY doc_id
""")
def b2(spark, sf):
    return B.plain_text(rich_blocks(spark, sf))


@query("b3_word_offsets", f"""
WITH {RICH_BLOCKS}, {OFFSETS.replace('{src}', 'rich_blocks')} SELECT doc_id, block_idx, n_words, word_offset FROM offs
""")
def b3(spark, sf):
    return B.word_offsets(rich_blocks(spark, sf)).select("doc_id", "block_idx", "n_words", "word_offset")


@query("b4_pauseable_index", f"""
WITH {RICH_BLOCKS}, {OFFSETS.replace('{src}', 'rich_blocks')}
SELECT doc_id, word_offset AS word_idx, block_idx, type AS kind,
  CASE WHEN type = 'code' THEN payload ELSE {TRIM.format(x='payload')} END AS payload
FROM offs WHERE type IN ('image', 'formula', 'table', 'code') AND {TRIM.format(x='payload')} <> ''
""")
def b4(spark, sf):
    return B.pauseable(rich_blocks(spark, sf))


@query("b5_heading_outline", f"WITH {TOC} SELECT doc_id, toc_idx, block_idx, level, title, word_idx FROM toc")
def b5(spark, sf):
    return B.heading_items(conv_blocks(spark, sf))


@query("b6_b7_outline_nesting", f"""
WITH RECURSIVE {RICH_TOC}, chain AS (
  SELECT doc_id, toc_idx, parent_idx, 1 AS depth FROM toc WHERE parent_idx IS NULL
  UNION ALL SELECT t.doc_id, t.toc_idx, t.parent_idx, c.depth + 1 FROM toc t
  JOIN chain c ON t.doc_id = c.doc_id AND t.parent_idx = c.toc_idx)
SELECT doc_id, toc_idx, parent_idx, depth FROM chain
""")
def b6(spark, sf):
    return B.outline(rich_blocks(spark, sf)).select("doc_id", "toc_idx", "parent_idx", "depth")


@query("b9_active_section", f"""
WITH {TOC}, p AS (SELECT event_id, doc_id % (SELECT count(DISTINCT conv_id) FROM conversations) AS doc_id,
   word_idx FROM ({'WITH ' + POSITIONS} SELECT * FROM positions))
SELECT event_id, p.doc_id, p.word_idx, (SELECT max(toc_idx) FROM toc t WHERE t.doc_id = p.doc_id AND t.word_idx <= p.word_idx) AS active_idx
FROM p
""")
def b9(spark, sf):
    n = table(spark, sf, "conversations").agg(F.count_distinct("conv_id")).scalar()
    pos = positions(spark, sf).select("event_id", (F.col("doc_id") % n).alias("doc_id"), "word_idx")
    return B.active_section(pos, B.heading_items(conv_blocks(spark, sf))).select(
        "event_id", "doc_id", "word_idx", "active_idx")


@query("b10_outline_filter", f"""
WITH {TOC} SELECT doc_id, toc_idx, title FROM toc WHERE contains(lower(title), 'tion')
""")
def b10(spark, sf):
    return B.filter_titles(B.heading_items(conv_blocks(spark, sf)), " TION ").select(
        "doc_id", "toc_idx", "title")


NORM = r"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query("b11_heading_pages", f"""
WITH {RICH_TOC}, src AS (
  SELECT doc_id, toc_idx, CASE WHEN toc_idx % 3 = 0 THEN block_idx END AS block_idx,
    CASE WHEN toc_idx % 3 = 1 THEN title || '^1' WHEN toc_idx % 3 = 2 THEN array_to_string(string_split(title, ' ')[1:3], ' ') || ' zzz' ELSE title END AS title
  FROM toc),
nd AS (SELECT *, {NORM.format(x='title')} AS full_n,
    CASE WHEN array_to_string(string_split(title, ' ')[1:3], ' ') <> title THEN {NORM.format(x="array_to_string(string_split(title, ' ')[1:3], ' ')")} END AS short_n FROM src),
hit AS (SELECT n.doc_id, n.toc_idx, arg_min(b.page, CASE WHEN contains({NORM.format(x='b.text')}, full_n) THEN 0 ELSE 1000000 END + b.block_idx) AS page
  FROM nd n JOIN rich_blocks b ON b.doc_id = n.doc_id
   AND (contains({NORM.format(x='b.text')}, full_n) OR (short_n <> '' AND contains({NORM.format(x='b.text')}, short_n)))
  WHERE full_n <> '' GROUP BY ALL)
SELECT s.doc_id, s.toc_idx, coalesce(b.page, hit.page) AS page
FROM src s LEFT JOIN rich_blocks b USING (doc_id, block_idx) LEFT JOIN hit ON hit.doc_id = s.doc_id AND hit.toc_idx = s.toc_idx
""")
def b11(spark, sf):
    blocks = rich_blocks(spark, sf)
    i, t = F.col("toc_idx") % 3, F.col("title")
    toc = B.heading_items(blocks).select(
        "doc_id", "toc_idx", F.when(i == 0, F.col("block_idx")).alias("block_idx"),
        F.when(i == 1, F.concat(t, F.lit("^1")))
        .when(i == 2, F.concat(F.array_join(F.slice(F.split(t, " "), 1, 3), " "), F.lit(" zzz")))
        .otherwise(t).alias("title"))
    return B.heading_pages(toc, blocks)


@query("b12_match_normalisation", f"SELECT doc_id, {NORM.format(x='text')} AS norm FROM documents")
def b12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", W.normalize_match(F.col("text")).alias("norm"))


@query("b13_outline_suppression", f"""
WITH {TOC}, r AS (SELECT doc_id FROM toc WHERE parent_idx IS NULL GROUP BY doc_id HAVING count(*) > 1)
SELECT doc_id, toc_idx, title FROM toc WHERE doc_id IN (SELECT doc_id FROM r)
""")
def b13(spark, sf):
    return B.suppress_short(B.outline(conv_blocks(spark, sf))).select("doc_id", "toc_idx", "title")


KINDS = ["paragraph", "heading", "list", "code", "quote", "table", "image", "formula"]


@query("b14_block_type_profile", f"""
WITH {RICH_BLOCKS}, {OFFSETS.replace('{src}', 'rich_blocks')}
SELECT doc_id, count(*) AS n_blocks, {', '.join(f"count(*) FILTER (WHERE type = '{k}') AS n_{k}" for k in KINDS)},
  sum(n_words)::BIGINT AS n_words,
  round(sum(CASE WHEN type IN ('paragraph', 'heading', 'list', 'quote') THEN n_words ELSE 0 END)::DOUBLE / sum(n_words), 6) AS prose_share
FROM offs GROUP BY doc_id
""")
def b14(spark, sf):
    return B.type_profile(rich_blocks(spark, sf), KINDS)


@query("b15_prepend_title", f"""
WITH {CONV_BLOCKS}, t AS (SELECT conv_id AS doc_id, CASE WHEN conv_id % 3 <> 0 THEN role || ' ' || conv_id ELSE '' END AS title
  FROM conversations WHERE turn = 0)
SELECT doc_id, block_idx + CASE WHEN title <> '' THEN 1 ELSE 0 END AS block_idx, type, level, text
FROM conv_blocks LEFT JOIN t USING (doc_id)
UNION ALL SELECT doc_id, 0, 'heading', 1, title FROM t WHERE title <> ''
""")
def b15(spark, sf):
    c = F.col("conv_id")
    titles = table(spark, sf, "conversations").where("turn = 0").select(
        c.alias("doc_id"),
        F.when(c % 3 != 0, F.concat("role", F.lit(" "), c.cast("string"))).otherwise("").alias("title"))
    return B.prepend_title(conv_blocks(spark, sf), titles)


HITS = f"""
tok AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS word_idx
  FROM (SELECT doc_id, regexp_extract_all(text, {PAT}, 0) AS w FROM documents)),
{TERM_SQL},
hits AS (SELECT doc_id, query_id, word_idx, word FROM tok JOIN terms ON q <> '' AND contains(lower(word), lower(q)))
"""


@query("q1_find_words", f"WITH {HITS} SELECT doc_id, query_id, word_idx, word FROM hits")
def q1(spark, sf):
    return S.find_words(table(spark, sf, "documents"), TERMS)


OCC = f"""
pieces AS (SELECT {{keys}}, query_id, len(q) AS n, unnest(s) AS part, unnest(range(len(s))) AS match_idx, len(s) AS k
  FROM (SELECT {{keys}}, query_id, q, string_split(lower(text), lower(q)) AS s FROM {{src}}, terms WHERE q <> '')),
occ AS (SELECT {{keys}}, query_id, match_idx, k,
  (sum(len(part)) OVER (PARTITION BY {{keys}}, query_id ORDER BY match_idx) + match_idx * n)::BIGINT AS "start", n FROM pieces)
"""


@query("q2_text_occurrences", f"""
WITH {TERM_SQL}, {OCC.format(keys='doc_id', src='documents')}
SELECT doc_id, query_id, match_idx, "start", "start" + n AS "end" FROM occ WHERE match_idx < k - 1
""")
def q2(spark, sf):
    return S.occurrences(table(spark, sf, "documents"), TERMS)


@query("q3_occurrence_word_index", f"""
WITH {TERM_SQL}, {OCC.format(keys='doc_id', src='documents')},
p AS (SELECT doc_id, unnest(s) AS piece, unnest(range(len(s))) AS pos
  FROM (SELECT doc_id, string_split(regexp_replace(text, {PAT}, chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS s FROM documents)),
e AS (SELECT doc_id, pos, sum(len(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM p),
r AS (SELECT doc_id, pos // 2 AS word_idx, e::BIGINT AS we FROM e WHERE pos % 2 = 1)
SELECT o.doc_id, o.query_id, o.match_idx, o."start", coalesce(r.word_idx + 1, 0) AS word_idx
FROM occ o ASOF LEFT JOIN r ON o.doc_id = r.doc_id AND o."start" >= r.we
WHERE o.match_idx < o.k - 1
""")
def q3(spark, sf):
    return S.occurrence_words(table(spark, sf, "documents"), TERMS)


@query("q4_match_neighbours", f"""
WITH {HITS}
SELECT doc_id, query_id, word_idx,
  coalesce(lead(word_idx) OVER w, min(word_idx) OVER (PARTITION BY doc_id, query_id)) AS next_idx,
  coalesce(lag(word_idx) OVER w, max(word_idx) OVER (PARTITION BY doc_id, query_id)) AS prev_idx
FROM hits WINDOW w AS (PARTITION BY doc_id, query_id ORDER BY word_idx)
""")
def q4(spark, sf):
    return S.find_word_neighbours(table(spark, sf, "documents"), TERMS)


@query("q5_escape_regex", r"""
SELECT page_id, regexp_replace(url, '[.*+?^${}()|\[\]\\]', '\\\0', 'g') AS pattern FROM pages
""")
def q5(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.escape_regex(F.col("url")).alias("pattern"))


@query("q6_block_bounded_occurrences", f"""
WITH {CONV_BLOCKS}, {TERM_SQL}, {OCC.format(keys='doc_id, block_idx', src='conv_blocks')}
SELECT doc_id, block_idx, query_id, match_idx, "start", "start" + n AS "end" FROM occ WHERE match_idx < k - 1
""")
def q6(spark, sf):
    return S.occurrences(conv_blocks(spark, sf), TERMS, ["doc_id", "block_idx"])


RARE = ["zung", "tionou", "Ñado", "euxment", "e..", "ß"]
RARE_SQL = "terms AS (SELECT unnest(range({n})) AS query_id, unnest([{l}]) AS q)".format(
    n=len(RARE), l=", ".join(sql_text(t) for t in RARE))


@query("q7_concordance", f"""
WITH wd AS (SELECT doc_id, regexp_extract_all(text, {PAT}, 0) AS w FROM documents), {HITS.replace(TERM_SQL, RARE_SQL)}
SELECT doc_id, query_id, word_idx, word, array_to_string(w[greatest(word_idx - 4, 1):word_idx], ' ') AS previous_words,
  array_to_string(w[word_idx + 2:word_idx + 61], ' ') AS upcoming_words
FROM hits JOIN wd USING (doc_id)
""")
def q7(spark, sf):
    return S.concordance(table(spark, sf, "documents"), RARE)


@query("q8_match_totals", f"""
WITH wd AS (SELECT doc_id, list_transform(regexp_extract_all(text, {PAT}, 0), lambda x: lower(x)) AS w FROM documents), {TERM_SQL}
SELECT doc_id, query_id, CASE WHEN q = '' THEN 0 ELSE len(list_filter(w, lambda x: contains(x, lower(q)))) END AS n FROM wd, terms
""")
def q8(spark, sf):
    return S.match_totals(table(spark, sf, "documents"), TERMS)


@query("q1_indexed_find_words", f"WITH {HITS} SELECT doc_id, query_id, word_idx, word FROM hits")
def q1_indexed(spark, sf):
    docs = table(spark, sf, "documents")
    return WordIndex(spark, shared_dir(spark, "word-index")).add(docs).find(
        spark.createDataFrame(list(enumerate(TERMS)), "query_id INT, text STRING"))


# The words of the benchmark items, five letters or longer, are the queries: the plan stays the same however many.
@query("q8_indexed_match_totals", f"""
WITH asked AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{{5,}}', 0))) AS q FROM benchmark),
tok AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, {PAT}, 0)) AS word FROM documents) GROUP BY ALL),
voc AS (SELECT DISTINCT word FROM tok),
held AS (SELECT word, q FROM voc JOIN asked ON contains(lower(word), q))
SELECT doc_id, q AS query_id, sum(n)::INTEGER AS n FROM tok JOIN held USING (word) GROUP BY doc_id, q
""")
def q8_indexed(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    word = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0)))
    asked = items.select(word.alias("w")).select(F.lower("w").alias("query_id")).distinct().withColumn("text", F.col("query_id"))
    return WordIndex(spark, shared_dir(spark, "word-index")).add(docs).totals(asked)


@query("q9_hit_states", f"""
WITH h AS (SELECT doc_id, list_transform(regexp_extract_all(text, {PAT}, 0), lambda w: contains(lower(w), 'tion')) AS h FROM documents),
a AS (SELECT doc_id, h, coalesce(list_position(h, TRUE), 0) - 1 AS first FROM h),
u AS (SELECT doc_id, first, unnest(range(len(h))) AS word_idx, unnest(h) AS hit FROM a)
SELECT doc_id, word_idx, CASE WHEN word_idx = first THEN 'active' WHEN hit THEN 'hit' ELSE 'none' END AS state FROM u
""")
def q9(spark, sf):
    return S.hit_states(table(spark, sf, "documents"), "Tion")
