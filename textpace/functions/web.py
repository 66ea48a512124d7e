"""HTML and URL expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from textpace.functions.words import trim_space

# --- fixed values ---
BOILERPLATE = ("script", "style", "nav", "header", "footer", "aside", "noscript", "iframe", "form")
BASIC_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]
TEXT_ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"), ("&hellip;", "…"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"),
    ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&amp;", "&"),
]
LOGIN_PATHS = ("/login", "/signin", "/sign-in", "/sign_in", "/auth/", "/sso/", "/account/login", "/users/sign_in")
LOGIN_QUERIES = ("next=", "redirect=", "return_to=")
TEXT_TYPES = ("application/xhtml+xml", "application/xml", "application/json", "application/ld+json",
              "application/rss+xml", "application/atom+xml")
ADDRESS = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
# --- end of fixed values ---

MARKUP = r"<!--(?s:.*?)-->|<[^>]+>|[^<]+"


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def drop_boilerplate(html: Column) -> Column:
    for tag in BOILERPLATE:
        html = F.regexp_replace(html, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return html


def collapse(text: Column) -> Column:
    return trim_space(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def strip_tags(html: Column) -> Column:
    """Tags to spaces, six entities decoded in order, white space collapsed."""
    return collapse(replace_all(F.regexp_replace(html, "<[^>]+>", " "), BASIC_ENTITIES))


def page_text(html: Column, from_raw: bool = False) -> Column:
    """Readable text of a page; ``from_raw`` keeps boilerplate, as the last fallback does."""
    return strip_tags(html if from_raw else drop_boilerplate(html))


def html_word_count(html: Column) -> Column:
    """Words of a markup string; tags and entities separate words."""
    plain = F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"&[a-zA-Z0-9#]+;", " ")
    return F.size(F.filter(F.split(plain, r"\s+"), lambda w: w != ""))


def decode_entities(text: Column) -> Column:
    """Named entities decoded in one pass; unknown ones stay as they are."""
    names = "|".join(e[1:-1] for e, _ in TEXT_ENTITIES)
    table = F.create_map(*[F.lit(x) for e, c in TEXT_ENTITIES for x in (e[1:-1], c)])
    parts = F.split(F.regexp_replace(text, f"&({names});", "\u0001$1\u0001"), "\u0001")
    return F.array_join(
        F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.try_element_at(table, p)).otherwise(p)), "")


def attr(tag: Column, name: str) -> Column:
    """Value of a tag attribute, empty when absent."""
    pat = rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    return F.regexp_replace(F.coalesce(F.regexp_extract(tag, pat, 1), F.lit("")), "^[\"']|[\"']$", "")


def clean_block(text: Column) -> Column:
    """Blanks collapse per line, 3+ newlines become two, single newlines become spaces."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda l: F.array_join(F.filter(F.split(l, "[ \t]"), lambda p: p != ""), " "))
    joined = F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")
    kept = F.replace(F.replace(joined, F.lit("\n\n"), F.lit("\u0000")), F.lit("\n"), F.lit(" "))
    return trim_space(F.replace(kept, F.lit("\u0000"), F.lit("\n\n")))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def validate_url(text: Column) -> Column:
    """Struct of reason (null when valid) and the normalised url; checks run in this order."""
    t = trim_space(text)
    full = F.when(F.contains(t, F.lit("://")), t).otherwise(F.concat(F.lit("https://"), t))
    scheme = F.lower(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    h = host(full)
    reason = (
        F.when(t == "", "empty")
        .when((scheme == "") | full.rlike(r'[\s<>"{}|\\^`]'), "invalid_format")
        .when(scheme == "file", "local_file")
        .when(~scheme.isin("http", "https"), "unsupported_scheme")
        .when(h == "", "missing_host")
        .when(h.rlike(ADDRESS), "ip_address")
        .when(h == "localhost", "local_file")
        .when(~F.contains(h, F.lit(".")), "invalid_format")
        .when(F.contains(h, F.lit("..")), "suspicious")
    )
    return F.struct(reason.alias("reason"), F.when(reason.isNull(), full).alias("url"))


def looks_like_url(text: Column) -> Column:
    t = trim_space(text)
    return (
        F.when(t == "", False)
        .when(F.contains(t, F.lit("://")), host(t) != "")
        .otherwise(F.contains(t, F.lit(".")) & (F.length(t) >= 4))
    )


def upgrade_scheme(url: Column) -> Column:
    return F.regexp_replace(url, "^http://", "https://")


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def _query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def login_redirect(requested: Column, landed: Column) -> Column:
    moved = (_path(requested) != _path(landed)) | (_query(requested) != _query(landed))
    p, q = F.lower(_path(landed)), F.lower(_query(landed))
    return moved & (
        _any([F.contains(p, F.lit(x)) for x in LOGIN_PATHS])
        | _any([F.contains(q, F.lit(x)) for x in LOGIN_QUERIES])
    )


def response_class(url: Column, status: Column, content_type: Column, n_bytes: Column, head: Column) -> Column:
    """http_error, pdf, suspicious, text or other."""
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    pdf = F.lower(_path(url)).endswith(".pdf") | F.contains(ct, F.lit("application/pdf")) | head.startswith("%PDF")
    return (
        F.when(pdf, "pdf")
        .when(~status.between(200, 299), "http_error")
        .when(status.isin(202, 204) | (n_bytes < 100), "suspicious")
        .when(ct.startswith("text/") | _any([F.contains(ct, F.lit(t)) for t in TEXT_TYPES]), "text")
        .otherwise("other")
    )


def display_title(url: Column, title: Column) -> Column:
    t = F.coalesce(F.nullif(title, F.lit("")), F.nullif(host(url), F.lit("")), url)
    return F.when(F.length(t) > 28, F.concat(F.substring(t, 1, 26), F.lit("..."))).otherwise(t)


def display_domain(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(host(url), r"^www\.", ""), F.lit("")), url)


def resolve_url(ref: Column, base: Column) -> Column:
    """A reference against its page address, dot segments removed."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(_path(base), r"^(.*/)", 1), F.lit("")), F.lit("/"))
    rel = F.regexp_extract(ref, r"^([^?#]*)", 1)
    tail = F.substring(ref, F.length(rel) + 1, F.length(ref))
    whole = F.when(rel.startswith("/"), rel).otherwise(F.concat(folder, rel))
    parts = F.aggregate(
        F.split(whole, "/"), F.array().cast("array<string>"),
        lambda s, p: F.when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(1))))
        .when(p == ".", s).otherwise(F.concat(s, F.array(p))))
    last_dot = whole.rlike(r"(^|/)\.\.?$")
    path = F.concat(F.array_join(parts, "/"), F.when(last_dot, "/").otherwise(""))
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(rel == "", F.when(tail.startswith("?"), F.concat(origin, _path(base), tail))
              .when(tail == "", F.regexp_replace(base, "#.*$", ""))
              .otherwise(F.concat(F.regexp_replace(base, "#.*$", ""), tail)))
        .otherwise(F.concat(origin, path, tail))
    )
