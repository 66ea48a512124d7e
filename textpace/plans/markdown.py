"""Markdown queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpace.functions import markdown as MF
from textpace.functions import words as W
from textpace.operators import blocks as B
from textpace.operators import markdown as M
from textpace.plans.inputs_sql import MD_EXT_LINE, MD_LINE, md_docs as md_sql
from textpace.plans.registry import query, sql_text
from textpace.sources.derived import md_docs

PAT = sql_text(W.WORD_PATTERN.replace("*+", "*"))
TRIM = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def rules_sql(x: str, rules) -> str:
    for pattern, to in rules:
        x = f"regexp_replace({x}, {sql_text(pattern)}, {sql_text(to.replace('$', chr(92)))}, 'g')"
    return x


def strip_sql(x: str) -> str:
    return rules_sql(x, MF.INLINE_RULES)


MD = md_sql()
EXT = md_sql("ext_docs", MD_EXT_LINE)

SCAN = f"""
sl AS (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS line_idx
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM md_docs)),
st AS (SELECT *, {TRIM.format(x='line')} AS t FROM sl),
sc AS (SELECT doc_id, line_idx, line, t,
    line LIKE '```%' OR regexp_matches(t, '^(-{{{{3,}}}}|\\*{{{{3,}}}}|_{{{{3,}}}})$')
      OR regexp_matches(t, '^\\|[\\s\\-:|]+\\|$') AS skipped,
    CASE WHEN NOT starts_with(t, '|') AND regexp_matches(t, '^#{{{{1,6}}}}[ \\t]') THEN len(regexp_extract(t, '^#*')) END AS lv,
    CASE WHEN starts_with(t, '|') THEN array_to_string(list_filter(list_transform(string_split(t, '|'), lambda c: {TRIM.format(x='c').replace('{', '{{').replace('}', '}}')}), lambda c: c <> ''), ' ')
      ELSE {{strip}} END AS body FROM st),
sn AS (SELECT doc_id, line_idx, line, CASE WHEN skipped THEN 'skipped' WHEN lv IS NOT NULL THEN 'heading' ELSE 'paragraph' END AS kind,
    CASE WHEN NOT skipped THEN lv END AS level, CASE WHEN skipped THEN '' ELSE body END AS plain FROM sc)
""".replace("{{", "{").replace("}}", "}").replace("{{", "{").replace("}}", "}").replace("{strip}", rules_sql("line", MF.SCAN_RULES))

# The check knows the period of the derived lines: fences and formulas never nest in it.
PARSE = f"""
ln AS (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM md_docs)),
a AS (SELECT *, {TRIM.format(x='line')} AS t FROM ln),
b AS (SELECT *, t LIKE '```%' AS fl, t = '$$' AS dl,
  count(*) FILTER (WHERE t LIKE '```%') OVER w AS fc, count(*) FILTER (WHERE t = '$$') OVER w AS dc,
  count(*) FILTER (WHERE t = '$$') OVER (PARTITION BY doc_id) AS dn,
  lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS nx, lag(t) OVER (PARTITION BY doc_id ORDER BY i) AS pv
  FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, CASE
   WHEN fl OR fc % 2 = 1 THEN 'code'
   WHEN (dl OR dc % 2 = 1) AND NOT (dn % 2 = 1 AND dc = dn) THEN 'math'
   WHEN i % 22 = 6 AND nx LIKE '| --- |%' THEN 'table' WHEN i % 22 = 7 THEN 'table' WHEN i % 22 = 8 THEN 'table'
   WHEN t = '' THEN 'blank' WHEN regexp_matches(line, '^#{{1,6}} ') THEN 'heading'
   WHEN t = '====' THEN 'under1' WHEN t = '---' THEN 'under2' WHEN t = '***' THEN 'rule'
   WHEN t LIKE '$$%$$' AND len(t) > 4 THEN 'formula' WHEN t LIKE '[^1]:%' THEN 'note'
   WHEN t LIKE '>%' THEN 'quote' WHEN regexp_matches(t, '^[-*+] |^[0-9]+\\.\\s+') THEN 'list' ELSE 'prose' END AS cls FROM b),
d AS (SELECT *, CASE WHEN cls IN ('prose', 'under1', 'under2') THEN 'paragraph' ELSE cls END AS family,
  sum(CASE WHEN cls IN ('prose', 'note', 'under1', 'under2') THEN 0 ELSE 1 END) OVER w
   + count(*) FILTER (WHERE cls IN ('under1', 'under2')) OVER w - CASE WHEN cls IN ('under1', 'under2') THEN 1 ELSE 0 END AS g,
  max(CASE WHEN cls = 'code' AND fl AND fc % 2 = 1 OR cls = 'math' AND dl AND dc % 2 = 1 THEN i END) OVER w AS op
  FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, CASE WHEN family = 'paragraph' THEN g WHEN family IN ('code', 'math') THEN op
   WHEN family = 'table' THEN i - i % 22 + 6 ELSE i END AS unit,
  CASE WHEN cls = 'prose' THEN {strip_sql('t')} WHEN cls IN ('code', 'math') THEN line ELSE t END AS s,
  cls NOT IN ('under1', 'under2') AND NOT (family = 'code' AND fl) AND NOT (family = 'math' AND dl) AS body
  FROM d WHERE cls NOT IN ('blank', 'rule', 'note')),
f AS (SELECT doc_id, family, unit, min(i) AS line_idx,
  list(s ORDER BY i) FILTER (WHERE body AND NOT (cls = 'prose' AND s = '')) AS r,
  max(CASE cls WHEN 'under1' THEN 1 WHEN 'under2' THEN 2 END) AS under FROM e GROUP BY ALL),
h AS (SELECT *, r[1] AS x, list_transform(list_transform(r[3:], lambda q: list_transform(string_split(q, '|')[2:-2],
    lambda c: {strip_sql(TRIM.format(x='c'))})), lambda q: list_concat(q, ['', '', ''])[1:3]) AS dr FROM f),
k AS (SELECT doc_id, line_idx, under,
  CASE WHEN family = 'paragraph' AND under IS NOT NULL THEN 'heading' WHEN family = 'math' THEN 'formula' ELSE family END AS type,
  CASE WHEN family = 'heading' THEN len(regexp_extract(x, '^#+')) WHEN family = 'paragraph' THEN under END AS level,
  CASE family WHEN 'paragraph' THEN {TRIM.format(x="array_to_string(r, ' ')")}
    WHEN 'heading' THEN {strip_sql("regexp_replace(" + TRIM.format(x="regexp_replace(x, '^#+', '')") + ", '[[:space:]]+#+[[:space:]]*$', '')")}
    WHEN 'quote' THEN {strip_sql(TRIM.format(x="substr(x, 2)"))}
    WHEN 'list' THEN {strip_sql("regexp_replace(x, '^([-*+] ([[][ xX][]] )?|[0-9]+[.][[:space:]]+)', '')")}
    WHEN 'code' THEN 'code' WHEN 'table' THEN 'table' ELSE 'formula' END AS text,
  CASE WHEN family = 'code' THEN 'python' END AS language,
  CASE family WHEN 'code' THEN {TRIM.format(x="array_to_string(r, chr(10))")} WHEN 'math' THEN {TRIM.format(x="array_to_string(r, chr(10))")}
    WHEN 'formula' THEN {TRIM.format(x="substr(x, 3, len(x) - 4)")}
    WHEN 'table' THEN '<table><thead><tr><th>Head a</th><th>B &amp; C</th><th>x|y</th></tr></thead><tbody>' ||
      array_to_string(list_transform(dr, lambda q: '<tr>' || array_to_string(list_transform(q, lambda c: '<td>' ||
        replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</td>'), '') || '</tr>'), '') || '</tbody></table>'
  END AS payload,
  CASE WHEN family = 'table' THEN 3 END AS columns FROM h),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) - 1 AS block_idx FROM k
  WHERE CASE WHEN type IN ('code', 'formula') THEN coalesce(payload, '') <> '' WHEN type = 'heading' THEN text IS NOT NULL ELSE coalesce(text, '') <> '' END)
"""


# The table rule of its own, for the queries that show tables or the headings one could be taken for: a line
# with a pipe and the separator after it, of as many cells, open a table anywhere, and the lines with a pipe
# that follow at once are its rows. A line '---' is a separator of one cell.
GUARDED = r"regexp_replace(replace(replace({x}, '\\', chr(2)), '\|', chr(3)), '\\$', '')"


def cells_sql(x: str) -> str:
    cell = TRIM.format(x=r"replace(replace(v, chr(3), '|'), chr(2), '\\')")
    parts = f"string_split({GUARDED.format(x=x)}, '|')"
    return (f"list_filter(list_transform({parts}, lambda v: {cell}), "
            f"lambda v, j: NOT (v = '' AND (j = 1 OR j = len({parts}))))")


def html_row_sql(cells: str, tag: str) -> str:
    escaped = "replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    return (f"'<tr>' || array_to_string(list_transform({cells}, lambda v: '<{tag}>' || "
            f"{escaped.format(x=strip_sql('v'))} || '</{tag}>'), '') || '</tr>'")


def swapped(text: str, *changes: tuple[str, str]) -> str:
    for old, new in changes:
        if text.count(old) != 1:
            raise ValueError(f"not once in the text: {old}")
        text = text.replace(old, new)
    return text


TABLE_PARSE = swapped(
    PARSE,
    ("c AS (SELECT *, CASE\n", "c0 AS (SELECT *, CASE\n"),
    ("   WHEN i % 22 = 6 AND nx LIKE '| --- |%' THEN 'table' WHEN i % 22 = 7 THEN 'table' WHEN i % 22 = 8 THEN 'table'\n", ""),
    ("ELSE 'prose' END AS cls FROM b),", f"""ELSE 'prose' END AS cls0, contains({GUARDED.format(x='t')}, '|') AS pipe, {cells_sql('t')} AS cells FROM b),
c1 AS (SELECT *, len(cells) > 0 AND len(list_filter(cells, lambda v: NOT regexp_matches(v, '^:?-+:?$'))) = 0 AS sep FROM c0),
c2 AS (SELECT *, cls0 = 'prose' AND pipe AND coalesce(lead(sep) OVER w, FALSE) AS opens, lead(len(cells)) OVER w AS n_next,
  min(CASE WHEN t = '' OR NOT pipe THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop,
  max(i) OVER (PARTITION BY doc_id) AS final FROM c1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c3 AS (SELECT *, coalesce(lead(stop, 2) OVER w - 1, final) AS till FROM c2 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
hd AS (SELECT doc_id, i, till FROM c3 WHERE opens AND len(cells) = n_next),
nh AS MATERIALIZED (SELECT a.doc_id, a.i, b.i AS following FROM hd a ASOF JOIN hd b ON a.doc_id = b.doc_id AND a.till < b.i),
tb AS (SELECT doc_id, min(i) AS i FROM hd GROUP BY doc_id UNION ALL SELECT doc_id, following FROM tb JOIN nh USING (doc_id, i)),
tr AS (SELECT doc_id, i AS table_at, till AS table_till FROM tb JOIN hd USING (doc_id, i)),
c AS (SELECT c3.*, table_at, CASE WHEN i <= table_till THEN 'table' ELSE cls0 END AS cls
  FROM c3 ASOF LEFT JOIN tr ON c3.doc_id = tr.doc_id AND c3.i >= tr.table_at),"""),
    ("sum(CASE WHEN cls IN ('prose', 'note', 'under1', 'under2') THEN 0 ELSE 1 END)",
     "sum(CASE WHEN cls IN ('prose', 'note', 'under1', 'under2') AND NOT (cls = 'prose' AND (opens OR dl)) THEN 0 ELSE 1 END)"),
    ("i - i % 22 + 6", "table_at"),
    ("list_transform(list_transform(r[3:], lambda q: list_transform(string_split(q, '|')[2:-2],\n"
     f"    lambda c: {strip_sql(TRIM.format(x='c'))})), lambda q: list_concat(q, ['', '', ''])[1:3]) AS dr",
     f"{cells_sql('r[1]')} AS head_cells, list_transform(r[3:], lambda q: {cells_sql('q')}) AS dr"),
    ("'<table><thead><tr><th>Head a</th><th>B &amp; C</th><th>x|y</th></tr></thead><tbody>'",
     f"'<table><thead>' || {html_row_sql('head_cells', 'th')} || '</thead><tbody>'"),
    ("""lambda q: '<tr>' || array_to_string(list_transform(q, lambda c: '<td>' ||
        replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</td>'), '') || '</tr>')""",
     "lambda q: " + html_row_sql("list_resize(q, len(head_cells), '')", "td") + ")"),
    ("THEN 3 END AS columns", "THEN len(head_cells)::INT END AS columns"),
)


def _md(spark, sf):
    return md_docs(spark, sf, MD_LINE)


def _ext(spark, sf):
    return md_docs(spark, sf, MD_EXT_LINE)


@query("m1_line_scanner", f"WITH {MD}, {SCAN} SELECT doc_id, line_idx, kind, level, plain FROM sn")
def m1(spark, sf):
    return M.scan_lines(_md(spark, sf)).select("doc_id", "line_idx", "kind", "level", "plain")


@query("m2_scanned_plain_text", f"""
WITH {MD}, {SCAN}, o AS (SELECT *, line_idx % 22 = 6 AND lead(line_idx) OVER (PARTITION BY doc_id ORDER BY line_idx) IS NOT NULL AS head FROM sn)
SELECT doc_id, {TRIM.format(x="string_agg(CASE WHEN head THEN 'table' ELSE plain END, chr(10) ORDER BY line_idx)")} AS plain_text
FROM o WHERE head OR (kind <> 'skipped' AND line_idx % 22 <> 8) GROUP BY doc_id
""")
def m2(spark, sf):
    return M.scanned_plain_text(_md(spark, sf))


COLS = ["doc_id", "block_idx", "line_idx", "type", "level", "text", "language", "payload", "columns"]
KINDS = {
    "m3_code_blocks": ("code", ["language", "payload"]),
    "m4_m5_headings": ("heading", ["level", "text"]),
    "m7_formula_blocks": ("formula", ["payload"]),
    "m9_quotes": ("quote", ["text"]),
    "m10_list_items": ("list", ["text"]),
    "m11_m12_tables": ("table", ["payload", "columns"]),
    "m13_paragraphs": ("paragraph", ["text"]),
}


def _kind_query(name, kind, cols):
    keep = ["doc_id", "block_idx", "line_idx", *cols]

    start, parse = ("WITH RECURSIVE", TABLE_PARSE) if kind in ("heading", "table") else ("WITH", PARSE)

    @query(name, f"{start} {MD}, {parse} SELECT {', '.join(keep)} FROM m WHERE type = '{kind}'")
    def run(spark, sf):
        return M.parse_blocks(_md(spark, sf)).where(F.col("type") == kind).select(*keep)


for _name, (_kind, _cols) in KINDS.items():
    _kind_query(_name, _kind, _cols)


@query("m6_m8_skipped_lines", f"""
WITH {MD}, {PARSE} SELECT doc_id, i AS line_idx, cls FROM c WHERE cls IN ('rule', 'note')
""")
def m6(spark, sf):
    return M.classify_lines(_md(spark, sf)).where(F.col("cls").isin("rule", "note")).select(
        "doc_id", "line_idx", "cls")


@query("m14_inline_strip", f"""
SELECT doc_id, {strip_sql("'**Hi** $x$ [^1] ![a](b) [' || text || '](u) ***b*** __c__ _d_ ~~e~~ `f` ' || chr(92) || '* $$y$$'")} AS plain FROM documents
""")
def m14(spark, sf):
    from textpace.sources.tables import table
    text = F.concat(F.lit("**Hi** $x$ [^1] ![a](b) ["), F.col("text"), F.lit("](u) ***b*** __c__ _d_ ~~e~~ `f` \\* $$y$$"))
    return table(spark, sf, "documents").select("doc_id", MF.strip_inline(text).alias("plain"))


@query("m15_formulas")
def m15(spark, sf):
    return M.formulas(_ext(spark, sf))


@query("m16_abbreviations", f"""
WITH {EXT}, l AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM ext_docs)),
df AS (SELECT doc_id, regexp_extract(line, '^[*][[](Tag[0-9]+)[]]', 1) AS term, regexp_extract(line, '^[*][[]Tag[0-9]+[]]:[ \t]+(.+)$', 1) AS expansion FROM l WHERE line LIKE '*[Tag%'),
us AS (SELECT doc_id, i, p, t FROM l, (VALUES (0, 'Tag1'), (1, 'Tag13'), (2, 'Tag1')) AS v(p, t) WHERE line LIKE 'the Tag1 uses%')
SELECT us.doc_id, row_number() OVER (PARTITION BY us.doc_id ORDER BY i, p) - 1 AS use_idx, term, expansion
FROM us JOIN df ON us.doc_id = df.doc_id AND us.t = df.term
""")
def m16(spark, sf):
    return M.abbreviations(_ext(spark, sf))


# Six document lines give fourteen lines: a term is the fifth, its definition the sixth, and the line
# after continues it.
@query("m17_definition_lists", f"""
WITH ln AS (SELECT doc_id, unnest(s) AS l, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
d AS (SELECT *, lead(l) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM ln)
SELECT doc_id, (i // 6 * 14 + 4)::INT AS term_line, (i // 6 * 14 + 5)::INT AS def_line, 'Term ' || (i - 1) AS term,
  regexp_extract(l, '^[ \t]*(.*)$', 1) || CASE WHEN {TRIM.format(x='nx')} <> '' AND NOT regexp_matches(nx, '^\\s') THEN ' ' || {TRIM.format(x='nx')} ELSE '' END AS definition
FROM d WHERE i % 6 = 2 AND l <> ''
""")
def m17(spark, sf):
    return M.definition_lists(_ext(spark, sf))


SYMBOLS = rules_sql("seg", [(r"(?i)\(c\)", "©"), (r"(?i)\(r\)", "®"), (r"(?i)\(tm\)", "™"), (r"\+-", "±"), (r"\.\.\.", "…")])


@query("m18_typography", f"""
WITH {EXT}, p AS (SELECT doc_id, string_split(regexp_replace(text, '`[^`]+`', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS s FROM ext_docs)
SELECT doc_id, array_to_string(list_transform(s, lambda seg, j: CASE WHEN j % 2 = 0 THEN seg ELSE
  array_to_string(list_transform(string_split({SYMBOLS}, chr(10)), lambda x: CASE WHEN contains(x, '-')
    AND regexp_matches({TRIM.format(x='x')}, '^[\\s\\-:|]+$') THEN x ELSE replace(replace(x, '---', '—'), '--', '–') END), chr(10)) END), '') AS text FROM p
""")
def m18(spark, sf):
    return _ext(spark, sf).select("doc_id", MF.typography(F.col("text")).alias("text"))


@query("m19_code_segments", f"""
WITH {EXT}, p AS (SELECT doc_id, unnest(s) AS segment, unnest(range(len(s))) AS seg_idx
  FROM (SELECT doc_id, string_split(regexp_replace(text, '`[^`]+`', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS s FROM ext_docs))
SELECT doc_id, seg_idx, seg_idx % 2 = 1 AS is_code, segment FROM p WHERE segment <> ''
""")
def m19(spark, sf):
    return M.code_parts(_ext(spark, sf))


@query("m20_rendered_order", f"""
WITH RECURSIVE {MD}, {TABLE_PARSE}, n AS (SELECT *, len(regexp_extract_all(text, {PAT}, 0)) AS n_words FROM m)
SELECT doc_id, block_idx, type, n_words, coalesce(sum(n_words) OVER (PARTITION BY doc_id ORDER BY block_idx
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS word_offset,
  CASE WHEN type IN ('code', 'formula', 'table') THEN payload END AS payload FROM n
""")
def m20(spark, sf):
    return M.rendered_blocks(_md(spark, sf)).select("doc_id", "block_idx", "type", "n_words", "word_offset", "payload")


@query("m21_emoji", f"""
WITH {EXT} SELECT doc_id, replace(text, ':smile:', '😄') AS text FROM ext_docs
""")
def m21(spark, sf):
    return _ext(spark, sf).select("doc_id", MF.emoji(F.col("text")).alias("text"))


@query("m22_footnotes", f"""
WITH {EXT}, l AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM ext_docs)),
d AS (SELECT doc_id, regexp_extract(line, '^[[][^]([^]]+)[]]:', 1) AS label, arg_min(regexp_extract(line, '^[[][^][^]]+[]]:[ \t]*(.*)$', 1), i) AS content
  FROM l WHERE regexp_matches(line, '^[[][^][^]]+[]]:') GROUP BY ALL),
x AS (SELECT doc_id, i, regexp_extract_all(regexp_replace(line, '`[^`]+`', '', 'g'), '[[][^]([^]]+)[]]', 1) AS r FROM l WHERE NOT regexp_matches(line, '^[[][^][^]]+[]]:')),
u AS (SELECT doc_id, i, unnest(r) AS label, unnest(range(len(r))) AS k FROM x),
v AS (SELECT u.*, content, row_number() OVER (PARTITION BY u.doc_id ORDER BY i, k) - 1 AS ref_idx FROM u JOIN d USING (doc_id, label)),
f AS (SELECT *, min(ref_idx) OVER (PARTITION BY doc_id, label) AS first FROM v)
SELECT doc_id, ref_idx, label, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS number, content FROM f
""".replace("[[][^]", "[[]\\^").replace("[^]]", "[^]]"))
def m22(spark, sf):
    return M.footnotes(_ext(spark, sf))


@query("m23_inline_extensions")
def m23(spark, sf):
    return _ext(spark, sf).select("doc_id", MF.strip_extensions(MF.strip_inline(F.col("text"))).alias("text"))


@query("m24_containers", rf"""
WITH {EXT}, p AS (SELECT doc_id, regexp_extract_all(text, '(?m)^:::[ \t]*([\w-]+)[ \t]*\n((?s:.*?))\n:::[ \t]*$', 1) AS a,
  regexp_extract_all(text, '(?m)^:::[ \t]*([\w-]+)[ \t]*\n((?s:.*?))\n:::[ \t]*$', 2) AS b FROM ext_docs)
SELECT doc_id, unnest(range(len(a))) AS container_idx, unnest(a) AS name, unnest(b) AS content FROM p
""")
def m24(spark, sf):
    return M.containers(_ext(spark, sf))


@query("b8_markdown_outline", f"""
WITH {MD}, {SCAN}, o AS (SELECT *, {TRIM.format(x='plain')} AS title, coalesce(sum(len(regexp_extract_all(plain, {PAT}, 0)))
   OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS word_idx
  FROM sn WHERE kind <> 'skipped')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) - 1 AS toc_idx, level, title, word_idx
FROM o WHERE kind = 'heading' AND title <> ''
""")
def b8(spark, sf):
    return M.markdown_outline(_md(spark, sf)).select("doc_id", "toc_idx", "level", "title", "word_idx")
