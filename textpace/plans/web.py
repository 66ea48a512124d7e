"""Web page and URL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpace.functions import web as H
from textpace.operators import markup as K
from textpace.plans.registry import query, sql_text
from textpace.sources.derived import FETCH_LOG, URL_CASE, fetch_log, rich_pages, url_cases
from textpace.sources.tables import table


def _trim(x):
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _drop(x):
    for tag in H.BOILERPLATE:
        x = f"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}>', '', 'g')"
    return x


def _replace(x, pairs):
    for a, b in pairs:
        x = f"replace({x}, {sql_text(a)}, {sql_text(b)})"
    return x


def _collapse(x):
    return _trim(f"regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g')")


BODY = _drop("regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<head[^>]*>.*?</head>', '', 'g')")


@query("h1_boilerplate_removal", f"SELECT page_id, {_drop('html')} AS html FROM pages")
def h1(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.drop_boilerplate(F.col("html")).alias("html"))


def _strip(x):
    return _collapse(_replace(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')", H.BASIC_ENTITIES))


@query("h2_tag_strip", f"SELECT page_id, {_strip(_drop('html'))} AS text, {_strip('html')} AS raw_text FROM pages")
def h2(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", H.page_text(F.col("html")).alias("text"),
        H.page_text(F.col("html"), from_raw=True).alias("raw_text"))


@query("h3_html_word_count", """
SELECT page_id, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'),
  '&[a-zA-Z0-9#]+;', ' ', 'g'), '\\s+'), lambda w: w <> '')) AS n_words FROM pages
""")
def h3(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.html_word_count(F.col("html")).alias("n_words"))


def _body_pages(pages):
    return pages.withColumn("html", K.body_html(F.col("html")))


@query("h4_page_blocks", f"""
WITH t AS (SELECT page_id, unnest(x) AS tok, unnest(range(len(x))) AS pos FROM
  (SELECT page_id, regexp_extract_all({BODY}, '<[^>]+>|[^<]+', 0) AS x FROM pages)),
g AS (SELECT *, lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS tag, tok LIKE '</%' AS cl FROM t WHERE tok NOT LIKE '<!%'),
s AS (SELECT *, tag IN ('p', 'h1', 'div', 'article', 'body', 'html') AS bd FROM g),
q AS (SELECT *, sum(bd::INT) OVER (PARTITION BY page_id ORDER BY pos) AS seg FROM s),
b AS (SELECT page_id, seg, min(pos) AS pos, any_value(CASE WHEN bd THEN tag END) AS tag, any_value(CASE WHEN bd THEN cl END) AS cl,
   {_collapse(_replace("coalesce(string_agg(CASE WHEN tag = '' THEN tok END, '' ORDER BY pos), '')", H.TEXT_ENTITIES))} AS text
  FROM q GROUP BY page_id, seg)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS block_idx,
  CASE WHEN tag = 'h1' AND NOT cl THEN 'heading' ELSE 'paragraph' END AS type,
  CASE WHEN tag = 'h1' AND NOT cl THEN 1 END AS level, text FROM b WHERE text <> ''
""")
def h4(spark, sf):
    return K.blocks(_body_pages(table(spark, sf, "pages"))).select("page_id", "block_idx", "type", "level", "text")


@query("h4_h9_rich_page_blocks")
def h4r(spark, sf):
    return K.blocks(_body_pages(rich_pages(spark, sf)))


H1_TEXT = _collapse(_replace("regexp_extract(html, '<h1>(.*?)</h1>', 1)", H.TEXT_ENTITIES))


def _parts(kind, *cols):
    def run(spark, sf):
        return K.blocks(_body_pages(rich_pages(spark, sf))).where(F.col("type") == kind).select("page_id", *cols)
    return run


query("h5_list_items", f"""
SELECT page_id, {_trim("unnest(['• one ' || page_id, '• two inner', '1. first', '2. second ' || t])")} AS text
FROM (SELECT page_id, {H1_TEXT} AS t FROM pages)
""")(_parts("list", "text"))
query("h6_images", """
SELECT page_id, unnest(['/img/' || page_id || '.png', '../lazy/' || page_id || '.jpg', '//cdn.example.org/p.jpg?x=1', '/img/' || page_id || '.png']) AS payload,
  unnest(['Fig ' || page_id, NULL, NULL, NULL]) AS alt FROM pages
""")(_parts("image", "payload", "alt"))
query("h7_formula_sources", "SELECT page_id, 'x^' || page_id AS payload FROM pages")(_parts("formula", "payload"))
query("h8_code_language", """
SELECT page_id, 'py' AS language, 'a = 1' || chr(10) || '  b < 2' AS payload FROM pages
""")(_parts("code", "language", "payload"))
query("h9_table_columns", """
SELECT page_id, 3 AS columns, '<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td><td>' || page_id || '</td></tr></table>' AS payload FROM pages
""")(_parts("table", "columns", "payload"))


@query("h10_clean_block_text", f"""
WITH l AS (SELECT doc_id, list_transform(string_split(replace(text, '. ', '. ' || chr(10) || '  ' || chr(9)), chr(10)),
    lambda x: array_to_string(list_filter(regexp_split_to_array(x, '[ \t]'), lambda p: p <> ''), ' ')) AS s FROM documents)
SELECT doc_id, {_trim("replace(replace(replace(regexp_replace(array_to_string(s, chr(10)), chr(10) || '{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(10), chr(1)), chr(10), ' '), chr(1), chr(10) || chr(10))")} AS text FROM l
""")
def h10(spark, sf):
    raw = F.replace("text", F.lit(". "), F.lit(". \n  \t"))
    return table(spark, sf, "documents").select("doc_id", H.clean_block(raw).alias("text"))


@query("h11_page_metadata", f"""
SELECT page_id, {_collapse(_replace("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)", H.TEXT_ENTITIES))} AS title,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS language,
  regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www[.]', '') AS domain FROM pages
""")
def h11(spark, sf):
    return K.metadata(table(spark, sf, "pages")).select("page_id", "title", "language", "domain")


@query("h11_rich_page_metadata", f"""
WITH t AS (SELECT page_id, page_id % 2 = 0 AS e, {_collapse(_replace("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)", H.TEXT_ENTITIES))} AS title,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www[.]', '') AS domain FROM pages)
SELECT page_id, CASE WHEN e THEN 'OG ' || page_id ELSE title END AS title, CASE WHEN e THEN 'Ann & Bo' END AS author,
  CASE WHEN e THEN 'Desc ' || page_id END AS description, CASE WHEN e THEN '2024-01-0' || (1 + page_id % 9) END AS published,
  CASE WHEN e THEN 'Pub' END AS site, language, NULL AS image, domain FROM t
""")
def h11r(spark, sf):
    return K.metadata(rich_pages(spark, sf))


@query("h12_main_container")
def h12(spark, sf):
    return K.main_container(rich_pages(spark, sf))


@query("h13_unique_images", """
SELECT page_id, unnest(['/img/' || page_id || '.png', '../lazy/' || page_id || '.jpg', '//cdn.example.org/p.jpg?x=1']) AS src FROM pages
""")
def h13(spark, sf):
    return K.unique_images(K.blocks(_body_pages(rich_pages(spark, sf)))).select("page_id", "src")


@query("h14_resolved_links")
def h14(spark, sf):
    pages = rich_pages(spark, sf)
    refs = pages.select("page_id", "url", F.posexplode(
        F.regexp_extract_all("html", F.lit(r'(?i)\s(?:href|src)="([^"]*)"'), F.lit(1))).alias("ref_idx", "ref"))
    return refs.select("page_id", "ref_idx", "ref", H.resolve_url(F.col("ref"), F.col("url")).alias("url"))


CASES = f"""cases AS (SELECT page_id, {URL_CASE} AS url, u AS page_url FROM (SELECT page_id, url AS u FROM pages)),
v AS (SELECT page_id, {_trim('url')} AS t FROM cases),
w AS (SELECT page_id, t, CASE WHEN contains(t, '://') THEN t ELSE 'https://' || t END AS f FROM v),
x AS (SELECT *, lower(regexp_extract(f, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
  regexp_extract(f, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) AS h FROM w)"""


@query("h15_validate_url", f"""
WITH {CASES}, r AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN scheme = '' OR regexp_matches(f, '\\s') THEN 'invalid_format'
  WHEN scheme = 'file' THEN 'local_file' WHEN scheme NOT IN ('http', 'https') THEN 'unsupported_scheme' WHEN h = '' THEN 'missing_host'
  WHEN regexp_matches(h, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') THEN 'ip_address' WHEN h = 'localhost' THEN 'local_file'
  WHEN NOT contains(h, '.') THEN 'invalid_format' WHEN contains(h, '..') THEN 'suspicious' END AS reason FROM x)
SELECT page_id, reason, CASE WHEN reason IS NULL THEN f END AS url FROM r
""")
def h15(spark, sf):
    return url_cases(spark, sf).select("page_id", H.validate_url(F.col("url")).alias("v")).select("page_id", "v.*")


@query("h16_looks_like_url", f"""
WITH {CASES} SELECT page_id, CASE WHEN t = '' THEN FALSE WHEN contains(t, '://') THEN h <> '' ELSE contains(t, '.') AND len(t) >= 4 END AS ok FROM x
""")
def h16(spark, sf):
    return url_cases(spark, sf).select("page_id", H.looks_like_url(F.col("url")).alias("ok"))


@query("h17_scheme_upgrade", "SELECT page_id, regexp_replace(url, '^http://', 'https://') AS url FROM pages")
def h17(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.upgrade_scheme(F.col("url")).alias("url"))


@query("h18_login_redirect", f"""
WITH f AS ({FETCH_LOG}), p AS (SELECT page_id, requested_url <> landed_url AS moved, lower(landed_url) AS l,
  lower(regexp_extract(landed_url, '^https?://[^/?#]*([^?#]*)', 1)) AS path, lower(regexp_extract(landed_url, '[?]([^#]*)', 1)) AS q,
  regexp_extract(requested_url, '^https?://[^/?#]*([^?#]*)', 1) = regexp_extract(landed_url, '^https?://[^/?#]*([^?#]*)', 1)
  AND regexp_extract(requested_url, '[?]([^#]*)', 1) = regexp_extract(landed_url, '[?]([^#]*)', 1) AS same FROM f)
SELECT page_id, NOT same AND (regexp_matches(path, '/login|/signin|/sign-in|/sign_in|/auth/|/sso/|/account/login') OR regexp_matches(q, 'next=|redirect=|return_to=')) AS is_login FROM p
""")
def h18(spark, sf):
    return fetch_log(spark, sf).select(
        "page_id", H.login_redirect(F.col("requested_url"), F.col("landed_url")).alias("is_login"))


@query("h19_response_class", f"""
WITH f AS ({FETCH_LOG})
SELECT page_id, CASE WHEN regexp_matches(lower(landed_url), '^[^?#]*[.]pdf($|[?#])') OR contains(lower(coalesce(content_type, '')), 'application/pdf') OR head LIKE '%PDF%' AND starts_with(head, '%PDF') THEN 'pdf'
  WHEN status NOT BETWEEN 200 AND 299 THEN 'http_error' WHEN status IN (202, 204) OR n_bytes < 100 THEN 'suspicious'
  WHEN starts_with(lower(content_type), 'text/') OR contains(lower(content_type), 'application/xhtml+xml') THEN 'text' ELSE 'other' END AS class FROM f
""")
def h19(spark, sf):
    return fetch_log(spark, sf).select("page_id", H.response_class(
        F.col("landed_url"), F.col("status"), F.col("content_type"), F.col("n_bytes"), F.col("head")).alias("class"))


@query("h20_display_title", """
WITH t AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_extract(html, '(?s)<title>(.*?)</title>', 1) END AS title,
  regexp_extract(url, '^https?://([^/?#:]*)', 1) AS h FROM pages),
d AS (SELECT *, coalesce(nullif(title, ''), nullif(h, ''), url) AS x FROM t)
SELECT page_id, CASE WHEN len(x) > 28 THEN substr(x, 1, 26) || '...' ELSE x END AS title, regexp_replace(h, '^www[.]', '') AS domain FROM d
""")
def h20(spark, sf):
    title = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    return table(spark, sf, "pages").select(
        "page_id", H.display_title(F.col("url"), title).alias("title"), H.display_domain(F.col("url")).alias("domain"))
