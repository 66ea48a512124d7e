"""The derived inputs as SQL common table expressions, for the checks."""

SESSIONS = """
sessions AS (
  SELECT event_id, user_id, ts AS finished_at, value AS reading_time_seconds,
    (100 + (event_id % 19) * 50)::INT AS configured_wpm,
    floor(value * (1 + event_id % 9))::INT AS total_words,
    CASE event_id % 4 WHEN 0 THEN 'Text' WHEN 1 THEN 'URL' WHEN 2 THEN 'File' ELSE 'Area' END AS source
  FROM events)
"""
CONTROL = """
control AS (
  SELECT event_id, user_id, ts, CASE event_type WHEN 'view' THEN 'play' WHEN 'click' THEN 'pause'
    WHEN 'signup' THEN 'seek' WHEN 'error' THEN 'close' WHEN 'purchase' THEN 'finish' END AS action,
    floor(value)::INT AS word_idx,
    CASE event_id % 4 WHEN 0 THEN 'Text' WHEN 1 THEN 'URL' WHEN 2 THEN 'File' ELSE 'Area' END AS source
  FROM events)
"""
POSITIONS = """
positions AS (
  SELECT event_id, user_id, event_id % (SELECT count(*) FROM documents) AS doc_id,
    floor(value)::INT AS word_idx, ts FROM events)
"""
CONV_BLOCKS = """
conv_blocks AS (
  SELECT doc_id, block_idx, type,
    CASE WHEN type = 'heading' THEN (1 + (doc_id + block_idx) % 3)::INT END AS level,
    CASE WHEN type = 'code' THEN 'code' ELSE body END AS text,
    CASE WHEN type = 'code' THEN body END AS payload
  FROM (SELECT conv_id AS doc_id, turn AS block_idx, text AS body,
     CASE WHEN turn % 4 = 0 THEN 'heading' WHEN turn % 7 = 5 THEN 'code' ELSE 'paragraph' END AS type
     FROM conversations))
"""
RICH_BLOCKS = """
rich_blocks AS (
  SELECT c AS doc_id, t AS block_idx,
    CASE n WHEN 0 THEN 'heading' WHEN 1 THEN 'code' WHEN 2 THEN 'image' WHEN 3 THEN 'formula'
      WHEN 4 THEN 'table' WHEN 5 THEN 'list' WHEN 6 THEN 'quote' ELSE 'paragraph' END AS type,
    CASE WHEN n = 0 THEN (1 + t % 4)::INT END AS level,
    CASE n WHEN 1 THEN 'code' WHEN 2 THEN 'image' WHEN 3 THEN 'formula' WHEN 4 THEN 'table' ELSE body END AS text,
    CASE n WHEN 1 THEN body WHEN 2 THEN CASE WHEN c % 5 = 0 THEN ' ' ELSE ' https://img.example.org/' || t || '.png ' END
      WHEN 3 THEN CASE WHEN c % 4 = 0 THEN ' ' || chr(10) ELSE 'x^' || t END
      WHEN 4 THEN '<table><tr><td>' || t || '</td></tr></table>' END AS payload,
    1 + t // 2 AS page
  FROM (SELECT conv_id AS c, turn AS t, text AS body, (conv_id * 7 + turn) % 9 AS n FROM conversations))
"""

# Markdown made around document lines, none of which is lost; the same text serves Spark and the
# check. {i} is the zero-based line index and l the line; eleven lines give a period of 22.
MD_LINE = """CASE {i} % 11
  WHEN 0 THEN repeat('#', CAST(1 + {i} % 6 AS INT)) || ' ' || l || ' ##'
  WHEN 1 THEN '- [x] ' || l
  WHEN 2 THEN '12. ' || l
  WHEN 3 THEN '> ' || l || chr(10)
  WHEN 4 THEN '**Bold** ' || l || chr(10) || '| Head `a` | B & C | x' || chr(92) || '|y |' || chr(10) || '| --- | :--: | ---: |'
  WHEN 5 THEN '| ' || l || ' | 2 |' || chr(10) || '$$x^2 + ' || {i} || '$$'
  WHEN 6 THEN l || chr(10) || '```Python'
  WHEN 7 THEN '  ' || l || chr(10) || '```'
  WHEN 8 THEN l || chr(10) || '====' || chr(10) || '$$' || chr(10) || '  y_' || {i} || chr(10) || '$$'
  WHEN 9 THEN '[^1]: ' || l
  ELSE l || chr(10) || CASE WHEN {i} % 4 = 1 THEN '---' ELSE '***' END END"""
# Six lines give the marks of definition lists, notes, containers and inline extensions.
MD_EXT_LINE = """CASE {i} % 6
  WHEN 0 THEN l || ' :smile: and :nope: (c) (TM) ... -- +- --- `a -- b`'
  WHEN 1 THEN '*[Tag' || {i} || ']: full ' || l || chr(10) || 'the Tag1 uses `Tag1 -- code` Tag13 here, Tag1.' || chr(10) || chr(10) || 'Term ' || {i}
  WHEN 2 THEN ':   ' || l
  WHEN 3 THEN l || chr(10)
  WHEN 4 THEN '[^n' || {i} % 5 || ']: note ' || l || chr(10) || 'x[^n1] y[^n0] z[^nine] $x_' || {i} || '$ ' || chr(92) || '(a+b' || chr(92) || ') `$no$` $$z$$ costs $5 and $10'
  ELSE '::: warn' || chr(10) || l || chr(10) || ':::' || chr(10) || 'H~2~O 19^th^ ++in s++ ==mark== ~~strike~~ a ~ b' END"""


def md_docs(name: str = "md_docs", template: str = MD_LINE) -> str:
    body = template.replace("{i}", "(j - 1)")
    return (
        f"{name} AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), "
        f"lambda l, j: {body}), chr(10)) AS text FROM documents)"
    )
LAYOUT = """
dl AS (SELECT doc_id, unnest(s) AS text, unnest(range(len(s))) AS i, len(s) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
lb AS (SELECT doc_id, (1 + i // 20)::INT AS page, (i % 20)::INT AS line_idx, text,
  CASE WHEN doc_id % 2 = 0 AND i % 20 >= 10 THEN 320.0 ELSE 60.0 END::DOUBLE AS x_min,
  CASE WHEN doc_id % 2 = 0 AND i % 20 < 10 THEN 280.0 ELSE 540.0 END::DOUBLE AS x_max,
  CASE WHEN doc_id % 2 = 0 THEN i % 20 % 10 ELSE i % 20 END AS jj,
  CASE WHEN i % 15 = 0 THEN 18.0 ELSE 11.0 END::DOUBLE AS font_size, i % 9 = 0 AS bold FROM dl),
pg AS (SELECT DISTINCT doc_id, page FROM lb),
layout AS (SELECT *, y_center - 6 AS y_min, y_center + 6 AS y_max FROM (
  SELECT doc_id, page, line_idx, text, x_min, x_max, (760 - jj * 18 - jj // 5 * 14)::DOUBLE AS y_center, font_size, bold FROM lb
  UNION ALL SELECT doc_id, page, -1, 'Running Header ' || doc_id, 60, 300, 830, 11, FALSE FROM pg
  UNION ALL SELECT doc_id, page, 100, '1) see note ' || page, 60, 300, 60, 11, FALSE FROM pg
  UNION ALL SELECT doc_id, page, 101, '- ' || page || ' -', 290, 310, 20, 11, FALSE FROM pg)),
ol AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y_center DESC, line_idx) - 1 AS ord FROM layout
  WHERE regexp_matches(text, '[^\\s\\p{Z}]')),
gp AS (SELECT *, lag(y_center) OVER w - y_center AS gap, greatest(0, x_min - lag(x_max) OVER w, lag(x_min) OVER w - x_max) AS xgap
  FROM ol WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord)),
md AS (SELECT doc_id, page, list_sort(list(gap) FILTER (WHERE gap > 0 AND gap < 200)) AS g FROM gp GROUP BY ALL),
br AS (SELECT gp.*, ord > 0 AND (gap > coalesce(g[len(g) // 2 + 1], 12) * 1.6::DOUBLE OR xgap > 59.5) AS b FROM gp JOIN md USING (doc_id, page)),
cl AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY ord)::INT AS para_idx FROM br),
paras AS (SELECT doc_id, page, para_idx,
  replace(replace(string_agg(regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), chr(1) ORDER BY ord), '-' || chr(1), ''), chr(1), ' ') AS text,
  min(x_min) AS x_min, max(x_max) AS x_max, min(y_min) AS y, max(y_max) AS y_max, max(font_size) AS font_size,
  floor(sum(CASE WHEN bold THEN len(text) ELSE 0 END) * 100 / sum(len(text)))::INT AS bold_percent,
  min(y_min) / 842::DOUBLE > 0.9 AS is_at_top, min(y_min) / 842::DOUBLE < 0.1 AS is_at_bottom
  FROM cl GROUP BY doc_id, page, para_idx)
"""
