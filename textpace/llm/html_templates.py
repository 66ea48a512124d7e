"""Main-text extraction by equivalence-class template deduction.

Pages of one host share a template. A page is read as a sequence of tokens, the opening and
closing of its elements, each named by the element's path, with text in the gaps. Over the
pages of a host, tokens with equal occurrence vectors (the same number of times on the same
pages) form equivalence classes. Of a class whose tokens stand once on each of its pages those
stay that have the same place in its order on all of them. It is valid if it is large and no
better supported class crosses it: one lies in a gap of the other, or they lie apart. Valid classes
so nest into the host's template, and every gap between two tokens of the innermost class
around it is a slot. A slot whose text is the same on all its pages belongs to the template,
unless an element around it (not the body) has a slot that varies; the other slots hold
data. The main text is the text of the data slots in page order, without regions that
their element, role or class name marks as furniture. A page that is nothing but constant
text keeps it.

Names are evidence, not proof. A class or id token counts only if all its words name
furniture or its place (``ad-box``), or its last word does and its first does not deny it
(``main-widget``, not ``no-sidebar`` or ``share-price``). What forms and names of the second
kind mark is text all the same if it holds over half the text of the host's pages outside
elements that are never text; of the first kind, if it holds all that text, with prose.

Occurrence vectors are never gathered whole: each token's vector is represented by a sum of
page hashes, weighted by its count on the page, so equal sums over all pages of the host
mean equal vectors. What the deduction reads of a page, its tokens and the hashes of its
texts, is staged once; all sums are taken per task before they are shuffled.

Rules for odd input: null or empty html has no text; text without any tag is one block;
unclosed elements are closed by what must follow them; pages of any length are read whole;
copies of a page each get their text; slots need three pages to be constant, so smaller
hosts are read by their elements alone; an empty table gives an empty result; input columns
named like output columns are replaced, all other columns pass through.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructType

from textpace.llm.common import staged, without
from textpace.llm.url_templates import host_and_path

# Share of a host's pages on which a template token stands.
SUPPORT = 0.5
# Tokens that a valid class has at least, and pages that make a constant slot constant.
CLASS_TOKENS = 2
CONSTANT_PAGES = 3

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>", re.S)
ATTRIBUTE = re.compile(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

RAW = frozenset("script style textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li td th tr dt dd caption figcaption summary legend option".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li td dd".split())
HOLDERS = frozenset(
    "html head body div section article main nav aside footer header form ul ol dl menu table thead tbody tfoot "
    "blockquote pre figure details fieldset address center dialog noscript template svg iframe object select "
    "button canvas audio video map search".split())
FURNITURE = frozenset(
    "head nav aside footer menu dialog noscript template svg iframe object select button canvas audio video "
    "map search".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription sidebar sidebars menu menus nav "
    "navbar navigation breadcrumb breadcrumbs header masthead footer comment comments commentlist respond replies "
    "disqus share sharing social related recommended widget widgets toolbar pagination pager login signup skip".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
# Words that say where furniture stands or what it is made of, and words that deny a name.
PLACES = frozenset(
    "site page global top bottom left right upper lower primary secondary user reader google box bar slot unit wrap "
    "wrapper container inner outer block list item items links link button buttons panel area section posts number "
    "icons icon title text".split())
DENIALS = frozenset("no non not has have with without hide hidden".split())
COMMENTS = frozenset("comment comments commentlist respond replies disqus".split())
# How sure a mark is: never text, furniture unless it holds all text, furniture unless it holds most.
NEVER, STRONG, WEAK = 3, 2, 1


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(raw)} if raw else {}


@lru_cache(maxsize=1 << 14)
def _name_mark(name: str, inside: bool) -> int:
    """How far a class or id token marks furniture; inside an article, headers are text."""
    words = [w.lower() for w in WORDS.findall(name)]
    named = [w in NAMES and not (inside and w == "header") for w in words]
    if not any(named):
        return 0
    if all(n or w in PLACES for n, w in zip(named, words)):
        return STRONG
    if named[-1] and words[0] not in DENIALS:
        return STRONG if words[-1] in COMMENTS else WEAK
    return 0


def _mark(tag: str, attributes: dict[str, str], inside: bool) -> int:
    """How far tag, role, class or id say that this is not part of an article; ``inside`` one, headers are."""
    if tag in FURNITURE or (tag == "header" and not inside):
        return NEVER
    if tag == "form":
        return WEAK
    if not attributes or tag in ("html", "body") or (tag in ("article", "main") and not inside):
        return 0
    if attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
        return NEVER
    if attributes.get("role", "").lower() in ROLES:
        return STRONG
    return max((_name_mark(n, inside) for n in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()), default=0)


@lru_cache(maxsize=1 << 16)
def _token(above: int, name: str, outer: bool) -> int:
    """The name of an element's opening: its path hashed. Bit 0 is set on its closing, bit 1 on html and body."""
    return hash_text(f"{above:x}>{name}") & ~3 | outer << 1


class Page:
    """A page's tokens, its blocks as (tokens before it, text, marked never, doubtful elements around it),
    and its doubtful elements as {token: [characters, mark, holds prose]}."""

    def __init__(self, source: str):
        self.blocks: list[tuple[int, str, bool, tuple[int, ...]]] = []
        self.tokens: list[int] = []
        self.doubts: dict[int, list] = {}
        # tag, token, never text, in an article, doubtful elements around
        self.stack: list[tuple[str, int, bool, bool, tuple[int, ...]]] = [("", 0, False, False, ())]
        self.words: list[str] = []
        self.leaf, self.leaf_mark = "", 0              # the open leaf element and its mark
        at, end = 0, len(source)
        for m in TAG.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                self.words.append(source[at:m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self._close(tag)
                else:
                    self._open(tag, m[3])
                    if tag in RAW:
                        close = re.compile(f"</{tag}", re.I).search(source, at)
                        at = close.start() if close else end
        if at < end:
            self.words.append(source[at:])
        self._flush()
        self._pop(1)

    def _flush(self) -> None:
        if self.words:
            text = SPACE.sub(" ", html.unescape("".join(self.words))).strip()
            self.words = []
            if text:
                _, _, never, inside, doubts = self.stack[-1]
                never = never or self.leaf_mark == NEVER
                if self.leaf_mark in (WEAK, STRONG):   # a leaf is a doubtful element of its own
                    doubts = (*doubts, self._doubt(_token(self.stack[-1][1], f"{self.leaf}:{self.leaf_mark}", False), self.leaf_mark))
                if not never:
                    for d in doubts:
                        found = self.doubts[d]
                        found[0] += len(text)
                        found[2] = found[2] or inside or self.leaf in PROSE
                self.blocks.append((len(self.tokens), text, never, doubts))

    def _doubt(self, token: int, mark: int) -> int:
        found = self.doubts.setdefault(token, [0, mark, False])
        found[1] = max(found[1], mark)
        return token

    def _pop(self, at: int) -> None:
        self.tokens.extend(e[1] | 1 for e in reversed(self.stack[at:]))
        del self.stack[at:]

    def _open(self, tag: str, raw: str) -> None:
        if self.stack[-1][0] == "head" and (tag in LEAVES or tag in HOLDERS) and tag not in ("noscript", "template"):
            self._close("head")                        # content ends an unclosed head
        if tag == "br":
            self.words.append(" ")
        elif tag in LEAVES or tag == "hr":
            self._flush()
            self.leaf = tag
            self.leaf_mark = NEVER if tag == "option" else _mark(tag, _attributes(raw), self.stack[-1][3]) if raw else 0
        elif tag in HOLDERS:
            self._flush()
            self.leaf, self.leaf_mark = "", 0
            if raw.endswith("/") and tag not in ("article", "main", "body"):
                return
            attributes = _attributes(raw)
            _, above, never, inside, doubts = self.stack[-1]
            name = ".".join([tag, *sorted(re.sub(r"\d+", "#", c) for c in attributes.get("class", "").split())])
            token = _token(above, name, tag in ("html", "body"))
            mark = NEVER if "hidden" in raw.split() else _mark(tag, attributes, inside)
            if mark in (WEAK, STRONG):
                doubts = (*doubts, self._doubt(token, mark))
            self.tokens.append(token)
            self.stack.append((tag, token, never or mark == NEVER, inside or tag in ("article", "main"), doubts))

    def _close(self, tag: str) -> None:
        if tag in HOLDERS:
            self._flush()
            self.leaf, self.leaf_mark = "", 0
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == tag:
                    self._pop(i)
                    break
        elif tag in LEAVES:
            self._flush()
            self.leaf, self.leaf_mark = "", 0


def hash_text(text: str) -> int:
    """A hash that is the same in every process."""
    value = 0xCBF29CE484222325
    raw = text.encode("utf-8", "replace")
    for at in range(0, len(raw), 8):
        value = (value ^ int.from_bytes(raw[at:at + 8], "little")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        value ^= value >> 29
    return (value ^ len(raw)) & 0x7FFFFFFFFFFFFFFF


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for at in range(0, batch.num_rows, 256):
        yield from batch.slice(at, 256).to_pylist()


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the deduction needs of each page: tokens, hashes of the texts in its gaps, doubtful elements."""
    for batch in batches:
        out = []
        for row in _rows(batch):
            page = Page(row["html"])
            shown = [(at, text) for at, text, never, _ in page.blocks if not never]
            out.append({
                "host": row["host"], "number": row["number"], "tokens": page.tokens,
                "at": [at for at, _ in shown], "mark": [hash_text(text) for _, text in shown],
                "chars": sum(len(text) for _, text in shown),
                "doubts": [{"token": t, "held": n, "mark": m, "prose": p} for t, (n, m, p) in page.doubts.items()]})
        yield pa.RecordBatch.from_pylist(out, READ)


READ = pa.schema([("host", pa.string()), ("number", pa.int64()), ("tokens", pa.list_(pa.int64())),
                  ("at", pa.list_(pa.int32())), ("mark", pa.list_(pa.int64())), ("chars", pa.int64()),
                  ("doubts", pa.list_(pa.struct([("token", pa.int64()), ("held", pa.int64()), ("mark", pa.int32()),
                                                 ("prose", pa.bool_())])))])
READ_TYPES = ("host string, number long, tokens array<long>, at array<int>, mark array<long>, chars long, "
              "doubts array<struct<token: long, held: long, mark: int, prose: boolean>>")


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page and token: its occurrences, and the page's hash weighted by them."""
    names = ["host", "token", "total", "low", "high"]
    for batch in batches:
        found = []
        for row in _rows(batch):
            low, high = row["number"] & 0x7FFFFFFF, (row["number"] >> 31) & 0x7FFFFFFF
            times: dict[int, int] = {}
            for token in row["tokens"]:
                times[token] = times.get(token, 0) + 1
            found.extend((row["host"], t, n, low * n, high * n) for t, n in times.items())
        if found:
            types = [pa.string()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)


def order_on_page(tokens: list[int], classes: list[dict]) -> list[tuple[int, list[int], bool]]:
    """(class, its tokens in page order, whether a better supported class crosses it) for the classes on a page."""
    owner = {t: k for k, c in enumerate(classes) for t in c["tokens"]}
    rank = {k: i for i, k in enumerate(sorted(range(len(classes)), key=lambda k: (-classes[k]["pages"], min(classes[k]["tokens"]))))}
    order: dict[int, list[int]] = {}
    unfinished, crossed = [], set()
    for t in tokens:
        k = owner.get(t)
        if k is None:
            continue
        mine = order.setdefault(k, [])
        mine.append(t)
        if k in crossed:
            continue
        if len(mine) == 1:
            unfinished.append(k)
        while unfinished[-1] != k:
            if rank[unfinished[-1]] > rank[k]:
                crossed.add(unfinished.pop())
            else:
                crossed.add(k)
                unfinished.remove(k)
                break
        if k not in crossed and len(mine) == len(classes[k]["tokens"]):
            unfinished.pop()
    return [(min(classes[k]["tokens"]), mine, k in crossed) for k, mine in order.items()]


def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``order_on_page`` for every page, a row for each token with its place in its class."""
    schema = pa.schema([("host", pa.string()), ("class", pa.int64()), ("token", pa.int64()), ("place", pa.int32()),
                        ("crossed", pa.bool_())])
    for batch in batches:
        out = [{"host": r["host"], "class": c, "token": t, "place": i, "crossed": x}
               for r in _rows(batch) for c, order, x in order_on_page(r["tokens"], r["classes"]) for i, t in enumerate(order)]
        yield pa.RecordBatch.from_pylist(out, schema)


def slots_of(tokens: list[int], classes: list[list[int]]) -> list[int]:
    """The slot of each gap of a page: the last token before it of the innermost class around it, or 0."""
    places = {t: (k, i) for k, c in enumerate(classes) for i, t in enumerate(c)}
    around: list[list[int]] = []
    out = [0]
    for t in tokens:
        place = places.get(t)
        if place:
            k, i = place
            if i == 0:
                around.append([k, t])
            elif around:
                around[-1][1] = t
            if i == len(classes[k]) - 1 and len(around) > 1:
                around.pop()
        out.append(around[-1][1] if around else 0)
    return out


def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page and slot on it: the hash of the slot's text, 0 where it is empty, and the elements around it."""
    schema = pa.schema([("host", pa.string()), ("slot", pa.int64()), ("mark", pa.int64()), ("around", pa.list_(pa.int64()))])
    for batch in batches:
        out = []
        for row in _rows(batch):
            gaps = slots_of(row["tokens"], row["classes"])
            open_: list[int] = []
            around: dict[int, list[int]] = {gaps[0]: []}
            for t, slot in zip(row["tokens"], gaps[1:]):
                if not t & 2:
                    open_ = open_[:-1] if t & 1 else [*open_, t]
                around.setdefault(slot, open_)
            marks = dict.fromkeys(around, 0)
            for at, mark in zip(row["at"], row["mark"]):
                marks[gaps[at]] = (marks[gaps[at]] * 0x9E3779B97F4A7C15 + mark + 1) & 0x7FFFFFFFFFFFFFFF
            out.extend({"host": row["host"], "slot": s, "mark": m, "around": around[s]} for s, m in marks.items())
        yield pa.RecordBatch.from_pylist(out, schema)


def constant_slots(slots: DataFrame) -> DataFrame:
    """A row per host (host, constant) of its slots (host, slot, pages, least, most, around) that are template text."""
    varying = slots.where((F.col("least") != F.col("most")) & (F.size("around") > 0)) \
        .groupBy("host").agg(F.collect_set(F.element_at("around", -1)).alias("varying"))
    same = slots.where((F.col("least") == F.col("most")) & (F.col("most") != 0) & (F.col("pages") >= CONSTANT_PAGES))
    return same.join(varying, "host", "left") \
        .where(F.col("varying").isNull() | ~F.arrays_overlap("around", "varying")) \
        .groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("constant"))


def templates(pages: DataFrame) -> DataFrame:
    """A row per host (_host, _classes, _constant, _kept), from pages (host, html).

    Lists of a host are bounded by the tokens of a page over ``SUPPORT``, or by its depth.
    """
    number = F.xxhash64(F.monotonically_increasing_id(), "html")
    pages = staged(pages.select("host", number.alias("number"), "html").mapInArrow(read, READ_TYPES), "html-pages")

    whole = pages.groupBy("host").agg(F.count("*").alias("of"), F.sum("chars").alias("chars"))
    tokens = pages.select("host", "number", "tokens") \
        .mapInArrow(count, "host string, token long, total long, low long, high long").groupBy("host", "token") \
        .agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("total", "low", "high")])
    once = tokens.where(F.col("total") == F.col("pages")).join(whole, "host").where(F.col("pages") >= SUPPORT * F.col("of"))
    classes = once.groupBy("host", "pages", "low", "high").agg(F.collect_list("token").alias("tokens")) \
        .where(F.size("tokens") >= CLASS_TOKENS) \
        .groupBy("host").agg(F.collect_list(F.struct("tokens", "pages")).alias("classes"))

    ordered = pages.select("host", "tokens").join(classes, "host") \
        .mapInArrow(arrange, "host string, class long, token long, place int, crossed boolean") \
        .groupBy("host", "class", "token") \
        .agg(F.min("place").alias("place"), F.max("place").alias("other"), F.max("crossed").alias("crossed")) \
        .groupBy("host", "class").agg(
            F.max("crossed").alias("crossed"),
            F.sort_array(F.collect_list(F.when(F.col("place") == F.col("other"), F.struct("place", "token")))).alias("order"))
    nested = staged(ordered.where(~F.col("crossed") & (F.size("order") >= CLASS_TOKENS))
                    .groupBy("host").agg(F.sort_array(F.collect_list("order.token")).alias("classes")), "html-classes")

    slots = pages.select("host", "tokens", "at", "mark").join(nested, "host") \
        .mapInArrow(fill, "host string, slot long, mark long, around array<long>").groupBy("host", "slot") \
        .agg(F.count("*").alias("pages"), F.min("mark").alias("least"), F.max("mark").alias("most"),
             F.min("around").alias("around"))

    doubts = pages.select("host", F.explode("doubts").alias("d")).select("host", "d.*").groupBy("host", "token") \
        .agg(F.sum("held").alias("held"), F.max("mark").alias("mark"), F.max("prose").alias("prose")).join(whole, "host")
    most = (F.col("mark") == WEAK) & (2 * F.col("held") > F.col("chars"))
    all_ = (F.col("held") == F.col("chars")) & (F.col("held") > 0) & F.col("prose")
    kept = doubts.where(most | all_).groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("kept"))

    found = nested.join(constant_slots(staged(slots, "html-slots")), "host", "left").join(kept, "host", "full")
    return staged(found.select(F.col("host").alias("_host"), F.col("classes").alias("_classes"),
                               F.col("constant").alias("_constant"), F.col("kept").alias("_kept")), "html-templates")


def main_text(source: str, classes: list[list[int]] | None = None, constant: list[int] | None = None,
              kept: list[int] | None = None) -> str:
    """The page's text under its host's template."""
    page, known = Page(source), set(kept or ())
    blocks = [(at, text) for at, text, never, doubts in page.blocks if not never and known.issuperset(doubts)]
    if not constant:
        return "\n\n".join(text for _, text in blocks)
    gaps, same = slots_of(page.tokens, classes), set(constant)
    varying = [text for at, text in blocks if gaps[at] not in same]
    return "\n\n".join(varying or [text for _, text in blocks])


def extract(pages: DataFrame) -> DataFrame:
    """Add text and n_chars to every row (url, html)."""
    pages = without(pages, "text", "n_chars", "_host", "_own", "_classes", "_constant", "_kept")
    host = host_and_path(F.col("url"))[0]
    source = F.coalesce("html", F.lit(""))
    found = templates(pages.select(host.alias("host"), source.alias("html")))
    joined = pages.withColumn("_own", host).join(found, F.col("_own") == F.col("_host"), "left") \
        .select(*pages.columns, "_classes", "_constant", "_kept")
    schema = StructType(pages.schema.fields[:]).add("text", StringType()).add("n_chars", LongType())

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            values = [batch.column(names.index(c)).to_pylist() for c in ("html", "_classes", "_constant", "_kept")]
            texts = [main_text(h or "", *rest) for h, *rest in zip(*values)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-3], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=schema.fieldNames())

    return joined.mapInArrow(run, schema)
