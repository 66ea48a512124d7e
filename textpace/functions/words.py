"""Word pattern and word-level expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: the pattern must give the same words as the source application ---
# Pictographic ranges stand in for \p{Extended_Pictographic}, which Java's regex lacks.
PICTOGRAPHIC = (
    r"\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}"
    r"\x{231A}\x{231B}\x{2328}\x{2388}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}"
    r"\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{27BF}"
    r"\x{2934}\x{2935}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}"
    r"\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1F3FA}\x{1F400}-\x{1FAFF}"
)
QUOTES = "\"'«»„‚‹›"
CURLY_QUOTES = "“”‘’"
CURRENCY = "$€£¥₹₽¢"


def word_pattern(curly_quotes: bool = False) -> str:
    """The repeats are possessive so that a very long number list cannot exhaust the stack."""
    q = QUOTES + (CURLY_QUOTES if curly_quotes else "")
    url = r"https?://[^\s\p{Z}]+"
    opening = f"[{q}]*[{CURRENCY}]?"
    core = rf"[\p{{L}}\p{{N}}{PICTOGRAPHIC}]+(?:[.,]\p{{Nd}}+)*+(?:[-']\p{{L}}+)*+"
    closing = f"[%.,!?;:…{q}]*"
    return f"{url}|{opening}{core}{closing}"


WORD_PATTERN = word_pattern()
# One placeholder token stands for each block that has no prose.
PLACEHOLDERS = ("formula", "image", "code", "table")
ALNUM = r"[\p{L}\p{N}]"
NON_ALNUM = r"[^\p{L}\p{N}]"
# Unicode white space, for trimming.
SPACE = r"[\s\p{Z}\x{85}\x{0B}]"
# --- end of fixed values ---


def words(text: Column, curly_quotes: bool = False) -> Column:
    """Ordered ARRAY<STRING> of reading words."""
    return F.regexp_extract_all(text, F.lit(word_pattern(curly_quotes)), F.lit(0))


def word_count(text: Column) -> Column:
    """Words as the reader counts them."""
    return F.size(words(text))


def display_word_count(text: Column) -> Column:
    """Words as shown to a user: pieces between single spaces, empties dropped."""
    return F.size(F.filter(F.split(text, " "), lambda p: p != ""))


def is_placeholder(word: Column) -> Column:
    return word.isin(*PLACEHOLDERS)


def trim_space(text: Column) -> Column:
    """Strip all Unicode white space from both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\s\p{Z}\x{85}\x{0B}]")


def word_at(word_array: Column, idx: Column) -> Column:
    """Word at a zero-based index, empty outside the array."""
    return F.when(
        (idx >= 0) & (idx < F.size(word_array)), F.try_element_at(word_array, idx.cast("int") + 1)
    ).otherwise(F.lit(""))


def upcoming(word_array: Column, idx: Column, limit: int = 60) -> Column:
    return F.slice(word_array, F.greatest(F.lit(0), idx.cast("int") + 1) + 1, F.lit(limit))


def previous(word_array: Column, idx: Column, limit: int = 5) -> Column:
    end = F.least(F.greatest(F.lit(0), idx.cast("int")), F.size(word_array))
    start = F.greatest(F.lit(0), end - limit)
    return F.slice(word_array, start + 1, end - start)


def normalize_match(text: Column) -> Column:
    """Lower case, every non-alphanumeric run becomes one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), NON_ALNUM + "+", " "))


def let(value: Column, use) -> Column:
    """Bind a computed value so that a per-element expression reads it instead of redoing it."""
    return F.transform(F.array(value), use)[0]


def bind(value: Column, use) -> Column:
    """``let`` inside a fold: what ``use`` returns, such as all that was collected so far, is not copied."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, use)
