"""XML text as tokens, local names, attributes and decoded text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, functions as F

from textpace.functions.words import let

# --- fixed values: the forms of XML markup ---
TOKEN = r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""
NAME = r"^</?(?:[^\s/>:]+:)?([^\s/>:?!]+)"
REFERENCE = r"&(#[xX][0-9A-Fa-f]{1,6}|#[0-9]{1,7}|amp|lt|gt|quot|apos);"
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
# --- end of fixed values ---


def tokens(text: Column) -> Column:
    """Tags, comments, character data sections and the text between them, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def local_name(token: Column) -> Column:
    """Element name in lower case without its prefix; null for anything but a tag."""
    return F.nullif(F.lower(F.regexp_extract(token, NAME, 1)), F.lit(""))


def decode(text: Column) -> Column:
    """Character references decoded in one pass; those that name no character stay as they are."""
    table = F.create_map(*[F.lit(x) for e, c in NAMED.items() for x in (e, c)])

    def character(ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"^#[xX]?([0-9A-Fa-f]+)$", 1)
        code = F.when(ref.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
        n = F.when(ref.startswith("#"), code).cast("long")
        real = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        return F.when(real, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).when(
            n.isNull(), F.try_element_at(table, ref)).otherwise(F.concat(F.lit("&"), ref, F.lit(";")))

    parts = F.split(F.regexp_replace(text, REFERENCE, "\u0001$1\u0001"), "\u0001")
    plain = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, character(p)).otherwise(p)), "")
    return F.when(F.contains(text, F.lit("&")), plain).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of an attribute by its local name; null where the tag has none."""
    found = F.regexp_extract_all(
        tag, F.lit(rf"""\s(?:[^\s=:"'<>]+:)?{name}\s*=\s*("[^"]*"|'[^']*')"""), F.lit(1))
    return let(F.get(found, F.lit(0)), lambda v: decode(F.substring(v, F.lit(2), F.length(v) - 2)))


def text_of(token: Column) -> Column:
    """Text of a token that is no tag, else null. A character data section is taken as it stands."""
    return F.when(token.startswith("<![CDATA["), F.substring(token, F.lit(10), F.length(token) - 12)).when(
        ~token.startswith("<"), decode(token))


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def opening_tags(text: Column, name: str) -> Column:
    """Opening tags of one element, with any prefix, in order; none inside comments."""
    tag = rf"""<(?:[^\s<>/:]+:)?{name}(?=[\s/>])(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
    return F.regexp_extract_all(without_comments(text), F.lit(tag), F.lit(0))


# --- the same rules inside a task, for walks that must count open elements ---

_TOKEN, _NAME, _REFERENCE = re.compile(TOKEN, re.A), re.compile(NAME, re.A), re.compile(REFERENCE, re.A)
BLIP = re.compile(r"<(?:[^\s/>:]+:)?blip\b", re.A)
# Tags that give a paragraph style, number, font, image or white space.
SAYING = frozenset(("pstyle", "ilvl", "numpr", "rfonts", "blip", "tab", "br"))


# What a walk of table cells may pass over: comments, closing tags of what only starts, and tags of names it does not count.
_PREFIX, _REST = r"""(?:[^\s/>:<"']++:)?+""", r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
_PASSED = (rf"""(?:<!--.*?-->|</{_PREFIX}(?i:p|tab|br)\s*+>|"""
           rf"""</?+(?!!){_PREFIX}(?!(?i:body|tbl|tr|tc|t|tab|br|p)[\s/>])[^\s/>:?!<"']++(?=[\s/>]){_REST})*+""")


def _opening(name: str) -> str:
    """An opening tag with content, whose attributes hold a slash in quotes only."""
    return rf"""<{_PREFIX}(?i:{name})(?:\s(?:[^<>"'/]++|"[^"]*+"|'[^']*+')*+)?+>"""


# Most cells hold one paragraph of one text: such a cell is one piece. All else is a token.
_CELL = rf"""{_opening("tc")}{_PASSED}{_opening("p")}{_PASSED}{_opening("t")}([^<]++)</{_PREFIX}[tT]\s*+>{_PASSED}</{_PREFIX}(?i:tc)\s*+>"""
_CELL_PIECE = re.compile(rf"(?s){_PASSED}(?:{_CELL}|({TOKEN.removeprefix('(?s)')})|\Z)", re.A)


def cell_pieces(text: str) -> list[tuple[str, str]]:
    """What a walk of table cells must look at: (text, "") for a cell of one text, or ("", token); ("", "") at the end."""
    return _CELL_PIECE.findall(text)


# A table tag, or what may hold the like without being one.
TABLE = re.compile(r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|</?(?:[^\s/>:!?]+:)?(?i:tbl)(?![^\s/>?!])(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>""", re.A)


def pieces(text: str, start: int = 0) -> Iterator[re.Match]:
    return _TOKEN.finditer(text, start)


def pieces_of(text: str) -> list[str]:
    return _TOKEN.findall(text)


@lru_cache(8192)
def named(tag: str) -> tuple[str, int, bool]:
    """Local name ("" for comments and the like), what the tag adds to the open elements, whether it opens one."""
    found = None if tag.startswith("<!--") else _NAME.match(tag)
    closes = tag.startswith("</")
    return found[1].lower() if found else "", 0 if tag.endswith("/>") else -1 if closes else 1, not closes


def is_text(tok: str) -> bool:
    return tok[0] != "<" or tok.startswith("<![CDATA[")


def _character(found: re.Match) -> str:
    ref = found[1]
    if ref[0] != "#":
        return NAMED[ref]
    n = int(ref[2:], 16) if ref[1] in "xX" else int(ref[1:])
    return chr(n) if 1 <= n <= 0xD7FF or 0xE000 <= n <= 0x10FFFF else found[0]


def decoded(text: str) -> str:
    """As ``decode``."""
    return _REFERENCE.sub(_character, text) if "&" in text else text


def text_in(token: str) -> str:
    """As ``text_of``, for a token of text."""
    return token[9:-3] if token.startswith("<![CDATA[") else decoded(token)


@lru_cache(8192)
def attribute_of(tag: str, name: str) -> str | None:
    """As ``attribute``."""
    found = re.search(rf"""\s(?:[^\s=:"'<>]+:)?{name}\s*=\s*("[^"]*"|'[^']*')""", tag, re.A)
    return decoded(found[1][1:-1]) if found else None
