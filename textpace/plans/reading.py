"""Token, pivot, pacing and time queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpace.functions import pacing as P
from textpace.functions import words as W
from textpace.operators import pacing, tokens
from textpace.plans.registry import query, sql_text
from textpace.sources.derived import conv_blocks, positions
from textpace.plans.inputs_sql import CONV_BLOCKS, POSITIONS
from textpace.sources.tables import table

PAT = sql_text(W.WORD_PATTERN.replace("*+", "*"))
TOK = f"""
tok AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS word_idx
  FROM (SELECT doc_id, regexp_extract_all(text, {PAT}, 0) AS w FROM documents))
"""
WORDS = f"wd AS (SELECT doc_id, lang, source, text, regexp_extract_all(text, {PAT}, 0) AS w FROM documents)"
VOCAB = f"""
vocab AS (
  SELECT word, count(*) AS n
  FROM (SELECT unnest(regexp_extract_all(text, {PAT}, 0)) AS word FROM documents) GROUP BY word)
"""
FACTOR = """(1.0::DOUBLE + greatest(len(word) - 8, 0) * 0.04::DOUBLE + CASE
  WHEN right(word, 1) IN ('.', '!', '?') THEN 1.0::DOUBLE
  WHEN right(word, 1) IN (',', ';', ':') THEN 0.4::DOUBLE
  WHEN right(word, 1) IN ('—', '–') THEN 0.4::DOUBLE
  WHEN right(word, 1) = '…' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)"""
# Words with edge punctuation, made from the vocabulary so that the rare cases occur.
EDGE_FORMS = ("{w}", "«{w}»", "$9.{n}", "{w}...", "{w}…", "{w}-{w}", "\"{w}!\"", "{w}{w}{w}{w}",
              "x", "--", "{w}.---.", "https://{w}.org/{n}", "—{w}—")


def edge_words(spark, sf):
    """Vocabulary words in thirteen edge forms."""
    vocab = tokens.vocabulary(table(spark, sf, "documents"))
    forms = F.array(*[
        F.replace(F.replace(F.lit(f), F.lit("{w}"), F.col("word")), F.lit("{n}"), F.length("word").cast("string"))
        for f in EDGE_FORMS
    ])
    return vocab.select(F.explode(forms).alias("word")).distinct()


EDGES = VOCAB + ", edges AS (SELECT DISTINCT replace(replace(f, '{w}', word), '{n}', len(word)::VARCHAR) AS word FROM vocab, (SELECT unnest([" + \
    ", ".join(sql_text(f) for f in EDGE_FORMS) + "]) AS f))"

PIVOT_PARTS = r"""
parts AS (
  SELECT word, n,
    CASE WHEN has THEN lead ELSE 0 END AS lead,
    CASE WHEN has THEN n - lead - trail ELSE n END AS core
  FROM (SELECT word, len(word) AS n, regexp_matches(word, '[\p{L}\p{N}]') AS has,
          len(regexp_extract(word, '^[^\p{L}\p{N}]*')) AS lead,
          len(regexp_extract(word, '[^\p{L}\p{N}]*$')) AS trail FROM edges)),
raw AS (
  SELECT word, n, lead, core, (lead + CASE
     WHEN core <= 1 THEN 0 WHEN core <= 5 THEN 1 WHEN core <= 8 THEN 2 WHEN core <= 12 THEN 3
     WHEN core <= 17 THEN 4 WHEN core = 18 THEN 5 WHEN core <= 25 THEN core // 2
     ELSE floor(core * 0.6::DOUBLE) END)::BIGINT AS p FROM parts),
spots AS (
  SELECT word, p, i FROM raw, unnest(range(n)) AS u(i)
  WHERE regexp_matches(substr(word, i + 1, 1), '[\p{L}\p{N}]')),
near AS (SELECT word, arg_min(i, abs(i - p) * 2 + CASE WHEN i > p THEN 1 ELSE 0 END) AS i FROM spots GROUP BY word),
piv AS (
  SELECT r.word, r.core, r.p AS raw_pivot,
    CASE WHEN r.p < r.n AND NOT regexp_matches(substr(r.word, r.p + 1, 1), '[\p{L}\p{N}]')
      THEN coalesce(near.i, least(r.p, r.n - 1)) ELSE least(r.p, r.n - 1) END AS pv
  FROM raw r LEFT JOIN near USING (word))
"""


@query("t1_tokenize", f"WITH {TOK} SELECT doc_id, word_idx, word FROM tok")
def t1(spark, sf):
    return tokens.tokenize(table(spark, sf, "documents"))


@query("t2_token_ranges", f"""
WITH p AS (
  SELECT doc_id, unnest(s) AS piece, unnest(range(len(s))) AS pos
  FROM (SELECT doc_id, string_split(regexp_replace(text, {PAT}, chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS s
        FROM documents)),
e AS (SELECT *, sum(len(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM p)
SELECT doc_id, (pos // 2)::BIGINT AS word_idx, piece AS word,
       (e - len(piece))::BIGINT AS "start", e::BIGINT AS "end"
FROM e WHERE pos % 2 = 1
""")
def t2(spark, sf):
    return tokens.token_ranges(table(spark, sf, "documents"))


@query("t3_t4_word_counts", f"""
SELECT doc_id, len(regexp_extract_all(text, {PAT}, 0)) AS n_words,
       len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n_display_words FROM documents
""")
def t3(spark, sf):
    return tokens.word_counts(table(spark, sf, "documents"))


@query("t5_word_length_features", f"""
WITH {VOCAB} SELECT word, n, len(word) AS length, len(word) > 8 AS is_long FROM vocab
""")
def t5(spark, sf):
    return tokens.vocabulary(table(spark, sf, "documents")).select(
        "word", "n", F.length("word").alias("length"), (F.length("word") > 8).alias("is_long"))


@query("t6_placeholder_flag", f"""
WITH {CONV_BLOCKS}, t AS (
  SELECT doc_id, unnest(w) AS word FROM (SELECT doc_id, regexp_extract_all(text, {PAT}, 0) AS w FROM conv_blocks))
SELECT doc_id, count(*) AS n_words,
       count(*) FILTER (WHERE word IN ('formula', 'image', 'code', 'table')) AS n_placeholders
FROM t GROUP BY doc_id
""")
def t6(spark, sf):
    return tokens.tokenize(conv_blocks(spark, sf)).groupBy("doc_id").agg(
        F.count("*").alias("n_words"),
        F.count_if(W.is_placeholder(F.col("word"))).alias("n_placeholders"))


LINES = f"""
ln AS (
  SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS line_idx
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
lw AS (SELECT doc_id, line_idx, regexp_extract_all(line, {PAT}, 0) AS w,
              NOT regexp_matches(line, '[^\\s\\p{{Z}}]') AS is_spacer FROM ln),
pa AS (
  SELECT doc_id, is_spacer, len(w) AS n_words, array_to_string(w, ' ') AS words,
    row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) - 1 AS para_idx,
    (sum(len(w)) OVER (PARTITION BY doc_id ORDER BY line_idx) - len(w))::BIGINT AS first_idx
  FROM lw WHERE is_spacer OR len(w) > 0)
"""


@query("t7_paragraphs", f"""
WITH {LINES} SELECT doc_id, para_idx, is_spacer, n_words, first_idx, words FROM pa
""")
def t7(spark, sf):
    return tokens.paragraphs(table(spark, sf, "documents")).withColumn(
        "words", F.array_join("words", " "))


@query("t7_block_paragraphs", f"""
WITH {CONV_BLOCKS}, ln AS (
  SELECT doc_id, block_idx, type, unnest(s) AS line, unnest(range(len(s))) AS line_idx, FALSE AS is_end
  FROM (SELECT doc_id, block_idx, type, string_split(text, chr(10)) AS s FROM conv_blocks)
  UNION ALL SELECT doc_id, block_idx, 'paragraph', '', 1000000, TRUE FROM conv_blocks
   WHERE (doc_id, block_idx) NOT IN (SELECT (doc_id, max(block_idx)) FROM conv_blocks GROUP BY doc_id)),
lw AS (SELECT *, regexp_extract_all(line, {PAT}, 0) AS w, NOT regexp_matches(line, '[^\\s\\p{{Z}}]') AS is_spacer FROM ln)
SELECT doc_id, block_idx, type, is_spacer, len(w) AS n_words, array_to_string(w, ' ') AS words,
    row_number() OVER (PARTITION BY doc_id ORDER BY block_idx, line_idx) - 1 AS para_idx,
    (sum(len(w)) OVER (PARTITION BY doc_id ORDER BY block_idx, line_idx) - len(w))::BIGINT AS first_idx
FROM lw WHERE is_spacer OR len(w) > 0
""")
def t7b(spark, sf):
    return tokens.block_paragraphs(conv_blocks(spark, sf)).withColumn(
        "words", F.array_join("words", " "))


@query("t8_paragraph_of_word", f"""
WITH {LINES}, {POSITIONS}
SELECT p.event_id, p.doc_id, p.word_idx, pa.first_idx AS paragraph_first
FROM positions p LEFT JOIN pa ON pa.doc_id = p.doc_id AND n_words > 0
  AND p.word_idx BETWEEN pa.first_idx AND pa.first_idx + pa.n_words - 1
""")
def t8(spark, sf):
    pos = positions(spark, sf).select("event_id", "doc_id", "word_idx")
    return tokens.locate_paragraphs(pos, table(spark, sf, "documents")).select(
        "event_id", "doc_id", "word_idx", "paragraph_first")


@query("t9_chunks", f"""
WITH {TOK}
SELECT doc_id, word_idx // 3 AS chunk_id, string_agg(word, ' ' ORDER BY word_idx) AS words
FROM tok GROUP BY ALL
""")
def t9(spark, sf):
    return tokens.chunks(table(spark, sf, "documents"), 3).withColumn(
        "words", F.array_join("words", " "))


@query("t10_previous_words", f"""
WITH {TOK}
SELECT doc_id, word_idx, word,
  coalesce(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY word_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '')
    AS previous_words
FROM tok
""")
def t10(spark, sf):
    return tokens.previous_context(table(spark, sf, "documents"))


@query("t11_t12_context_at_positions", f"""
WITH {WORDS}, {POSITIONS}
SELECT event_id, p.doc_id, word_idx,
  CASE WHEN word_idx < len(w) THEN w[word_idx + 1] ELSE '' END AS word,
  array_to_string(w[greatest(least(word_idx, len(w)) - 4, 1):least(word_idx, len(w))], ' ') AS previous_words,
  array_to_string(w[word_idx + 2:word_idx + 61], ' ') AS upcoming_words
FROM positions p JOIN wd USING (doc_id)
""")
def t11(spark, sf):
    pos = positions(spark, sf).select("event_id", "doc_id", "word_idx")
    return tokens.context_at(pos, table(spark, sf, "documents"))


@query("o1_o2_pivot", f"""
WITH {EDGES}, {PIVOT_PARTS} SELECT word, core AS core_length, raw_pivot, pv AS "pivot" FROM piv
""")
def o1(spark, sf):
    return P.with_pivot(edge_words(spark, sf))


@query("o3_split_at_pivot", f"""
WITH {EDGES}, {PIVOT_PARTS}
SELECT word, substr(word, 1, pv) AS before, substr(word, pv + 1, 1) AS pivot_char,
       substr(word, pv + 2) AS after FROM piv
""")
def o3(spark, sf):
    cut = P.split_at_pivot(F.col("word"), F.col("pivot"))
    return P.with_pivot(edge_words(spark, sf)).select("word", cut.alias("s")).select("word", "s.*")


@query("o4_chunk_pivot", f"""
WITH {TOK}, ch AS (
  SELECT doc_id, word_idx // 3 AS chunk_id, list(word ORDER BY word_idx) AS ws FROM tok GROUP BY ALL),
edges AS (SELECT DISTINCT ws[1] AS word FROM ch), {PIVOT_PARTS}
SELECT doc_id, chunk_id, pv AS "pivot", substr(word, 1, pv) AS before, substr(word, pv + 1, 1) AS pivot_char,
  substr(word, pv + 2) AS after,
  CASE WHEN len(ws) > 1 THEN ' ' || array_to_string(ws[2:], ' ') ELSE '' END AS trailing
FROM ch JOIN piv ON piv.word = ch.ws[1]
""")
def o4(spark, sf):
    return pacing.chunk_pivots(table(spark, sf, "documents"), 3)


@query("p1_word_delay", f"""
WITH {EDGES} SELECT word, round(60.0::DOUBLE / 300 * {FACTOR}, 6) AS delay FROM edges
""")
def p1(spark, sf):
    return edge_words(spark, sf).select("word", F.round(P.word_delay(F.col("word")), 6).alias("delay"))


BEATS = f"""
bt AS (
  SELECT doc_id, word_idx // 3 AS chunk_id, count(*) AS size,
    max(60.0::DOUBLE / 300 * {FACTOR}) * (1.0::DOUBLE + 0.3::DOUBLE * (count(*) - 1)) AS delay
  FROM tok GROUP BY ALL)
"""


@query("p2_chunk_delay", f"""
WITH {TOK}, {BEATS} SELECT doc_id, chunk_id, size, round(delay, 6) AS delay FROM bt
""")
def p2(spark, sf):
    return pacing.beats(table(spark, sf, "documents"), 300, 3).select(
        "doc_id", "chunk_id", F.size("words").alias("size"), F.round("delay", 6).alias("delay"))


@query("p3_schedule", f"""
WITH {TOK}, {BEATS}, s AS (SELECT *, sum(delay) OVER (PARTITION BY doc_id ORDER BY chunk_id) AS e FROM bt)
SELECT doc_id, chunk_id, round(e - delay, 4) AS start_s, round(e, 4) AS end_s FROM s
""")
def p3(spark, sf):
    return pacing.schedule(table(spark, sf, "documents"), 300, 3).select(
        "doc_id", "chunk_id", F.round("start_s", 4).alias("start_s"), F.round("end_s", 4).alias("end_s"))


def _at_positions(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", W.word_count(F.col("text")).alias("n_words"))
    return positions(spark, sf).select("event_id", "doc_id", "word_idx").join(docs, "doc_id")


AT = f"""{WORDS}, {POSITIONS}, spot AS (
  SELECT event_id, p.doc_id, word_idx, len(w) AS n_words FROM positions p JOIN wd USING (doc_id))"""


@query("p4_remaining_time", f"""
WITH {AT}, r AS (SELECT *, ceil((n_words - 1 - word_idx) / (300::DOUBLE * 3 / (1.0::DOUBLE + 0.3::DOUBLE * 2)) * 60)::BIGINT AS s FROM spot)
SELECT event_id, doc_id, CASE WHEN n_words - 1 - word_idx <= 0 THEN '0:00'
   ELSE printf('%d:%02d', s // 60, s % 60) END AS remaining FROM r
""")
def p4(spark, sf):
    return _at_positions(spark, sf).select(
        "event_id", "doc_id",
        P.remaining_time(F.col("n_words"), F.col("word_idx"), 300, 3).alias("remaining"))


@query("p5_progress", f"""
WITH {AT}, c AS (SELECT *, greatest(0, least(n_words - 1, word_idx)) AS i FROM spot)
SELECT event_id, doc_id, round(CASE WHEN n_words <= 0 THEN 0.0::DOUBLE
  WHEN n_words = 1 THEN CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END
  ELSE i::DOUBLE / (n_words - 1) * 100 END, 6) AS percent FROM c
""")
def p5(spark, sf):
    i = P.clamp_index(F.col("word_idx"), F.col("n_words"))
    return _at_positions(spark, sf).select(
        "event_id", "doc_id", F.round(P.progress(F.col("n_words"), i), 6).alias("percent"))


@query("p6_parameter_clamps", """
SELECT event_id, greatest(100, least(1000, (value * 4)::BIGINT)) AS wpm,
  greatest(1, least(7, event_id % 12 - 2)) AS chunk,
  greatest(2.0::DOUBLE, least(15.0::DOUBLE, round(value / 10, 3))) AS pause
FROM events
""")
def p6(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(
        "event_id", P.clamp_wpm(F.round(F.col("value") * 4).cast("long")).alias("wpm"),
        P.clamp_chunk(F.col("event_id") % 12 - 2).alias("chunk"),
        P.clamp_pause(F.round(F.col("value") / 10, 3)).alias("pause"))


CEIL_DUR = """CASE WHEN {s} // 60 > 0 AND {s} % 60 > 0 THEN printf('%d min %d sec', {s} // 60, {s} % 60)
  WHEN {s} // 60 > 0 THEN printf('%d min', {s} // 60) ELSE printf('%d sec', {s} % 60) END"""


def _ceil_dur(x):
    return CEIL_DUR.format(s=f"ceil({x})::BIGINT")


@query("p7_time_savings", f"""
WITH {WORDS}, v AS (SELECT doc_id, len(w) AS n, 200 + 50 * (doc_id % 5) AS wpm FROM wd),
s AS (SELECT *, n / 250::DOUBLE * 60 AS usual, n / wpm::DOUBLE * 60 AS paced FROM v)
SELECT doc_id, n AS n_words, wpm,
  CASE WHEN n > 0 THEN round(usual - paced, 6) END AS saved_seconds,
  CASE WHEN n > 0 THEN wpm / 250::DOUBLE END AS multiplier,
  CASE WHEN n > 0 THEN 'Normal: ' || {_ceil_dur('usual')} || ' · App: ' || {_ceil_dur('paced')} ||
    CASE WHEN usual - paced > 0 THEN ' · Save ' || {_ceil_dur('abs(usual - paced)')} || printf(' (%.1f×)', wpm / 250::DOUBLE)
    ELSE '' END END AS label
FROM s
""")
def p7(spark, sf):
    n = table(spark, sf, "documents").select(
        "doc_id", W.word_count(F.col("text")).alias("n_words"),
        (F.lit(200) + 50 * (F.col("doc_id") % 5)).alias("wpm"))
    return n.withColumn("s", P.time_savings(F.col("n_words"), F.col("wpm"))).select(
        "doc_id", "n_words", "wpm", F.round("s.saved_seconds", 6).alias("saved_seconds"),
        "s.multiplier", "s.label")


PAUSE_DOCS = f"""
pd AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY block_idx) AS text FROM conv_blocks GROUP BY doc_id),
tk AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS word_idx FROM
   (SELECT doc_id, regexp_extract_all(text, {PAT}, 0) AS w FROM pd))
"""


def _pause_docs(spark, sf):
    from textpace.operators.blocks import plain_text
    return plain_text(conv_blocks(spark, sf)).withColumnRenamed("plain_text", "text")


@query("p8_pause_plan", f"""
WITH {CONV_BLOCKS}, {PAUSE_DOCS}, f AS (
  SELECT *, word IN ('image', 'formula', 'table', 'code') AS stop FROM tk)
SELECT doc_id, word_idx, stop AS is_stop, round(CASE WHEN stop THEN 5.0::DOUBLE
  WHEN coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY word_idx), FALSE) THEN 0.6::DOUBLE
  ELSE 60.0::DOUBLE / 300 * {FACTOR} END, 6) AS delay
FROM f
""")
def p8(spark, sf):
    return pacing.pause_plan(_pause_docs(spark, sf), enabled={"code": True}).withColumn(
        "delay", F.round("delay", 6))


@query("p8_pause_plan_chunked", f"""
WITH RECURSIVE {CONV_BLOCKS}, {PAUSE_DOCS}, dw AS (SELECT doc_id, list(word ORDER BY word_idx) AS w,
  list(word_idx ORDER BY word_idx) FILTER (WHERE word IN ('image', 'formula', 'table', 'code')) AS marks FROM tk GROUP BY doc_id),
rs AS (SELECT doc_id, 0 AS run, 0::BIGINT AS s, list_min(list_filter(marks, lambda q: q % 3 = 0)) AS stop FROM dw
  UNION ALL SELECT rs.doc_id, run + 1, stop + 1, list_min(list_filter(marks, lambda q: q > stop AND (q - stop - 1) % 3 = 0)) FROM rs JOIN dw USING (doc_id) WHERE stop IS NOT NULL),
bs AS (SELECT doc_id, run, s, stop, w, unnest(range(s, coalesce(stop, len(w) - 1) + 1, 3)) AS word_idx FROM rs JOIN dw USING (doc_id)),
ps AS (SELECT *, w[word_idx + 1:least(word_idx + 3, coalesce(stop + 1, len(w)))] AS piece FROM bs)
SELECT doc_id, word_idx, coalesce(word_idx = stop, FALSE) AS is_stop, round(CASE WHEN word_idx = stop THEN 5.0::DOUBLE WHEN run > 0 AND word_idx = s THEN 0.6::DOUBLE
  ELSE list_max(list_transform(piece, lambda word: 60.0::DOUBLE / 300 * {FACTOR})) * (1 + {P.CHUNK_STRETCH}::DOUBLE * (len(piece) - 1)) END, 6) AS delay FROM ps
""")
def p8n(spark, sf):
    return pacing.pause_plan(_pause_docs(spark, sf), size=3, enabled={"code": True}).withColumn(
        "delay", F.round("delay", 6))


@query("p9_scrub_tooltip", f"""
WITH {WORDS}, r AS (SELECT doc_id, len(w) AS n, i / 8::DOUBLE AS ratio FROM wd, unnest(range(9)) AS u(i)),
t AS (SELECT *, greatest(0, n - floor(ratio * greatest(0, n - 1))) / 300::DOUBLE AS m FROM r)
SELECT doc_id, ratio, printf('%d%% · %s', round(ratio * 100)::BIGINT,
  CASE WHEN m < 1 THEN '< 1 min' ELSE printf('~%d min', ceil(m)::BIGINT) END) AS tooltip FROM t
""")
def p9(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", W.word_count(F.col("text")).alias("n"))
    at = docs.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i"))
    ratio = F.col("i") / F.lit(8.0)
    return at.select("doc_id", ratio.alias("ratio"), P.scrub_tooltip(ratio, F.col("n")).alias("tooltip"))


def _load_sql(by, group):
    return f"""
WITH {WORDS}, {TOK},
d AS (SELECT {by}, count(*) AS n_docs FROM documents GROUP BY {group}),
k AS (SELECT {by}, count(*) AS n_words, sum({FACTOR}) * 60.0::DOUBLE / 300 AS paced
      FROM tok JOIN documents USING (doc_id) GROUP BY {group})
SELECT {by}, n_docs, n_words, round(paced, 4) AS scheduled_s, round(n_words / 250::DOUBLE * 60, 4) AS usual_s,
  round(n_words / 250::DOUBLE * 60 - n_words / 300::DOUBLE * 60, 4) AS saved_s,
  round(n_words / paced * 60, 4) AS effective_wpm
FROM d JOIN k USING ({by})
"""


@query("reading_load_by_language", _load_sql("lang", "lang"))
def load_lang(spark, sf):
    return pacing.reading_load(table(spark, sf, "documents"), ["lang"])


@query("p10_reading_load_rollup", _load_sql("lang, source", "ROLLUP (lang, source)").replace(
    "FROM d JOIN k USING (lang, source)",
    "FROM d JOIN k ON d.lang IS NOT DISTINCT FROM k.lang AND d.source IS NOT DISTINCT FROM k.source"
).replace("SELECT lang, source, n_docs, n_words, round(paced", "SELECT d.lang, d.source, n_docs, n_words, round(paced"))
def load_rollup(spark, sf):
    return pacing.reading_load(table(spark, sf, "documents"), ["lang", "source"], rollup=True)
