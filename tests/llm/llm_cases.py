"""Small awkward tables, and plain versions of what the operators compute."""

import hashlib
import re
import zlib

from pyspark.sql.types import LongType, StringType, StructField, StructType

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A = ("The quick brown fox jumps over the lazy dog while seven quiet owls watch from the old barn and "
     "nobody in the village hears a single sound until the morning bell rings twice over the river.")
B = ("Der schnelle braune Fuchs springt über den faulen Hund, während sieben stille Eulen aus der alten "
     "Scheune zusehen und niemand im Dorf ein Geräusch hört, bis die Glocke zweimal läutet.")
LONG = " ".join(f"word{i % 977} item{i}" for i in range(6000))

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType()),
                   # Names that operators use themselves.
                   StructField("score", StringType()), StructField("kept", StringType()), StructField("taken", StringType())])
RAW = [
    (1, A, "en", "b"), (2, A, "en", "a"), (2, A, "en", "a"), (3, A + " End.", "en", "a"), (4, B, "de", None),
    (5, None, "en", "a"), (6, "", "en", ""), (7, " \t\n\x0b ", None, "a"), (8, "one two", "en", "é"), (9, "one two", None, "a"),
    (10, LONG, "en", "a"), (11, LONG.replace("item9 ", "item9x "), "en", "b"), (12, "12345 67890 !!!", "en", "a"),
    (13, "Write to ann.lee@mail.example.org or +49 (30) 1234-5678, card 4111 1111 1111 1111, host 10.0.0.255 not 10.0.0.256.", "en", "a"),
    (14, "Ünïcödé 😀 " + A.upper() + " a@b.c_d@e.f 1.2.3.4.5.6.7.8", "en", "b"), (None, B + " Ende.", "de", "b"),
    (15, "line one is here\nline one is here\n\nline two ### $$$\nline one is here", "en", "a"),
    (16, " ".join(["same eight words again and again and again"] * 12), "en", "a"), (17, "x" * 70000, "en", "c"),
]


def docs(spark, rows=None):
    full = [(i, t, lang, s, len(t) if t else None, "old", "old", "old") for i, t, lang, s in (RAW if rows is None else rows)]
    return spark.createDataFrame(full, DOCS)


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def crc(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def passages(rows, width=50):
    """(n_bytes, n_removed, n_spans, sha256) of each row (doc_id, text)."""
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - width + 1):
            if i is not None:
                least[raw[k:k + width]] = min(i, least.get(raw[k:k + width], i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - width + 1):
            if i is not None and least[raw[k:k + width]] < i:
                gone[k:k + width] = b"\1" * width
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text):
    w = words(lowered(text))
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def components(rows, similar=90):
    """doc row index -> (n_shingles, component id)."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similar * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return [(len(sets[a]), least.get(find(a)) if sets[a] else i) for a, (i, _) in enumerate(rows)]


KINDS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def private(text):
    """Base spans as kind:start:end."""
    found = []
    for rank, (kind, pattern) in enumerate(KINDS):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits)
                    or kind == "phone" and 9 <= len(digits) <= 15)
            if good:
                found.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def repeated_words(text):
    w, where, hit = words(text), {}, set()
    for k in range(len(w) - 7):
        where.setdefault(tuple(w[k:k + 8]), []).append(k)
    for at in where.values():
        if len(at) > 1:
            hit.update(p for k in at for p in range(k, k + 8))
    return len(hit)
