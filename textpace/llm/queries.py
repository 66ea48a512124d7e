"""One query for each operator, over its whole table."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textpace.llm import (
    decontamination, html_templates, langid, lexical_search, mixing, prefix_trie, privacy, quality, scoring, shingle_join,
    suffix_dedup, toxicity, url_templates,
)
from textpace.llm.common import crc_mod, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = textwrap.dedent(oracle).strip()
        return fn
    return add


@query("op1_mix_sources")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(scan(spark, sf_dir, "documents")).ledger.drop("source")


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "benchmark"))


@query("op4_quality_rules", """
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS text,
               list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
        FROM documents
    ), win AS (
        SELECT doc_id, i, list_slice(words, i, i + 7) AS w FROM (
            SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM d WHERE len(words) >= 8)
    ), twice AS (
        SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n > 1
    ), covered AS (
        SELECT doc_id, count(DISTINCT p) AS n FROM (
            SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM twice) GROUP BY doc_id
    ), m AS (
        SELECT d.doc_id, text, words, lines, len(words) AS n_words,
               coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
               length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
               len(lines) - len(list_distinct(lines)) AS n_dup_lines,
               coalesce(c.n, 0) AS n_repeat_words
        FROM d LEFT JOIN covered c USING (doc_id)
    ), b AS (
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed
           AND NOT n_symbols > 0.5 * n_words
           AND NOT n_dup_lines > 0.3 * len(lines)
           AND NOT (n_words >= 100 AND len(list_distinct(words)) < 0.05 * n_words)
           AND NOT len(list_filter(lines, lambda l: regexp_matches(l, '^[\\x20\\x09-\\x0D]*[-*]'))) > 0.9 * len(lines)
           AND NOT len(list_filter(lines, lambda l: regexp_matches(l, '[.][.][.][\\x20\\x09-\\x0D]*$'))) > 0.3 * len(lines)
           AND word_chars BETWEEN 2 * n_words AND 20 * n_words
           AND NOT length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) > length(regexp_replace(text, '[^\\p{Ll}]', '', 'g'))
           AS kept
    FROM b
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.cascade(docs).drop("text", "failed_rule")


@query("op5_lm_scoring")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    return scoring.score(docs.withColumn("held_out", held_out), docs.where(~held_out))


@query("op6_url_templates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(scan(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


@query("op8_privacy")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.find(scan(spark, sf_dir, "documents").select("doc_id", "text"))
    per_kind = [privacy.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in privacy.PATTERNS]
    return found.select(
        "doc_id", *per_kind, F.sha2(privacy.listed(F.col("base")), 256).alias("base_sha256"),
        privacy.listed(F.array_sort(F.concat("base", "terms"))).alias("spans"))


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(scan(spark, sf_dir, "documents"))


@query("op9_shingle_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.join(scan(spark, sf_dir, "documents"))


@query("op10_html_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_templates.extract(scan(spark, sf_dir, "pages")).drop("html")


@query("op11_toxicity")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    docs = scan(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    labels = scan(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    return toxicity.predict(docs, model).drop("text")


@query("op12_lexical_search", """
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
        FROM documents
    ), q AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
        FROM benchmark
    ), size AS (
        SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0
    ), tf AS (
        SELECT doc_id, term, count(*) AS tf, any_value(n) AS n
        FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
        WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term
    ), w AS (
        SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
        FROM tf, size GROUP BY term
    ), s AS (
        SELECT item_id, doc_id,
               sum(w * (1000000000 * tf // (1000 * tf + 8 * (100 - 90 + 90 * n * n_docs // n_terms))))::BIGINT AS score
        FROM q JOIN tf USING (term) JOIN w USING (term), size GROUP BY item_id, doc_id
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "benchmark"))


# The checksum goes through the digits of the id: each adds its code (a value of 0 or more), then
# eight shifts follow (each a -1).
@query("op13_prefix_trie", """
    WITH t AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                   left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32)) - 1 AS i,
               coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL
    ), c AS (
        SELECT conv_id, conv_id - conv_id % 100 AS base, count(*) AS n,
               xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
                       string_split(conv_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                   lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END),
                   4294967295::BIGINT) % 6 AS h
        FROM t GROUP BY conv_id
    ), lent AS (
        SELECT c.*, least(h, coalesce((SELECT n FROM c b WHERE b.conv_id = c.base), 0)) AS lent FROM c
    ), r AS (
        SELECT c.conv_id, i + 1 AS pos, role, text FROM lent c JOIN t ON t.conv_id = c.base AND i < lent
        UNION ALL
        SELECT c.conv_id, i - h + lent + 1, role, text FROM lent c JOIN t USING (conv_id) WHERE i >= h
    ), k AS (
        SELECT conv_id, pos, length(text) AS chars, sha256(string_agg(sha256(length(role) || ':' || role || text), ','
                   ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos)) AS node FROM r
        UNION ALL
        SELECT conv_id, 0, 0, 'root' FROM c
    ), p AS (
        SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY pos) AS parent,
               lead(node) OVER (PARTITION BY conv_id ORDER BY pos) IS NULL AS ends FROM k
    ), n AS (
        SELECT node, pos AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
               (count(*) - 1) * any_value(chars) AS saved,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
        FROM p GROUP BY node, pos
    ), kids AS (
        SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent
    ), below AS (
        SELECT p.node, sum((kids.node IS NULL)::BIGINT) AS n_leaves, sum(n.saved) AS saved_tokens
        FROM n JOIN p ON p.conv_id = n.conv_id AND p.pos <= n.depth LEFT JOIN kids ON kids.node = n.node GROUP BY p.node
    )
    SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
           coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
           n.ends_sha256
    FROM n JOIN below USING (node) LEFT JOIN kids ON kids.node = n.node LEFT JOIN n up ON up.node = n.parent
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rollup(scan(spark, sf_dir, "conversations"))
