"""Benchmark decontamination by pigeonhole edit matching.

A test item with a budget of e edits is cut into e+1 pieces: a match within the budget
leaves at least one piece intact. An automaton finds all intact pieces in one pass over a
text; each hit names a small window, and Myers' bit-parallel distance decides there.

Texts and items are compared in lower case, with every run of ASCII white space and
punctuation as one space; edits count UTF-8 bytes of that form, and positions refer to it.

Rules for odd input: null or empty texts and items match nothing; an item shorter than
``SHORT_BYTES`` in that form has no edit budget and must stand between word boundaries, as
edits of it hit ordinary prose; an item without letters or digits is empty; items with
equal text are separate items; repeated documents are reported each; an empty table
gives an empty result; other columns are ignored, or kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from textpace.llm.common import chunks

# Edits allowed for each byte of an item.
EDIT_RATE = 0.08
# Shorter items are matched exactly, as whole words.
SHORT_BYTES = 32
# Items are taken in blocks of about this much text, so what tasks hold stays bounded.
BLOCK_BYTES = 8 << 20

_PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def plain(text: str) -> str:
    """The compared form, one character for each UTF-8 byte."""
    words = text.lower().encode("utf-8", "replace").translate(_PLAIN).split()
    return b" ".join(words).decode("latin-1")


class Pattern:
    """A text to find within an edit budget."""

    def __init__(self, text: str, budget: int):
        self.text, self.budget = text, budget
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def search(self, text: str) -> tuple[int, int] | None:
        """Fewest edits to a substring of ``text`` and that substring's end, if within the budget."""
        m = len(self.text)
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score, best = full, 0, m, None
        for at, c in enumerate(text, 1):
            eq = self.masks.get(c, 0)
            vertical = eq | minus
            across = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | (full & ~(across | plus)), plus & across
            score += bool(up & top) - bool(down & top)
            up, down = (up << 1) & full, (down << 1) & full
            plus, minus = down | (full & ~(vertical | up)), up & vertical
            if score <= self.budget and (best is None or score < best[0]):
                best = score, at
        return best


class Items:
    """An automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.ids, self.patterns, self.backward, self.short = [], [], [], []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            form = plain(text)
            if not form:
                continue
            self.short.append(len(form) < SHORT_BYTES)
            budget = 0 if self.short[-1] else int(rate * len(form))
            cuts = [i * len(form) // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(form[a:b], []).append((len(self.ids), a))
            self.ids.append(item_id)
            self.patterns.append(Pattern(form, budget))
            self.backward.append(Pattern(form[::-1], budget))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str, first_only: bool = False) -> list[tuple[object, int, int, int]]:
        """(item, fewest edits, start, end) of the items that the text holds."""
        starts: dict[int, set[int]] = {}
        if self.ids:
            for end, (size, places) in self.automaton.iter(text):
                for k, offset in places:
                    if self.short[k] and text[end - size:end - size + 1] + text[end + 1:end + 2] not in ("", " ", "  "):
                        continue
                    starts.setdefault(k, set()).add(end + 1 - size - offset)
        out = []
        for k, found in starts.items():
            pattern, best = self.patterns[k], None
            m, e = len(pattern.text), pattern.budget
            region = None
            for at in [*sorted(found), None]:
                if region and (at is None or at > region[1] + e):
                    lo, hi = max(0, region[0] - e), region[1] + m + e
                    hit = pattern.search(text[lo:hi])
                    if hit and (best is None or hit[0] < best[0]):
                        best = hit[0], lo + hit[1]
                    region = None
                    if best and best[0] == 0:
                        break
                if at is not None:
                    region = (region[0], at) if region else (at, at)
            if best:
                edits, end = best
                back = self.backward[k].search(text[max(0, end - m - e):end][::-1])
                out.append((self.ids[k], edits, end - back[1], end))
                if first_only:
                    break
        return out


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size; a single long item is a block."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if held and size + len(row["text"]) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += len(row["text"])
    yield held


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """A row for each document and item it holds: doc_id, item_id, edits, start_at, end_at."""
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for block in blocks(benchmark):
        def run(batches, block=block):
            items = Items(block, rate)
            for batch, data, offsets in chunks(batches):
                ids = batch.column(0).to_pylist()
                rows = [(doc, *hit) for doc, a, b in zip(ids, offsets, offsets[1:])
                        for hit in items.find(plain(data[a:b].tobytes().decode("utf-8", "replace")))]
                cols = list(zip(*rows)) or [()] * 5
                names = ["doc_id", "item_id", "edits", "start_at", "end_at"]
                types = [batch.schema.types[0], None, pa.int64(), pa.int64(), pa.int64()]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, types)], names=names)
        found = docs.select("doc_id", "text").mapInArrow(
            run, f"doc_id {doc_type}, item_id {id_type}, edits long, start_at long, end_at long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for block in blocks(benchmark):
        def run(batches, block=block):
            items = Items(block, rate)
            for batch, data, offsets in chunks(batches):
                kept = [not items.find(plain(data[a:b].tobytes().decode("utf-8", "replace")), True)
                        for a, b in zip(offsets, offsets[1:])]
                yield batch.filter(pa.array(kept, pa.bool_()))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
