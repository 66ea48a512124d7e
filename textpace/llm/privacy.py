"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Patterns find the protected entities: addresses, numbers. The words around each entity are
its context. Over the whole corpus, the share of a term's occurrences that stand in the
context of one entity estimates the probability of that entity given the term; minus its
logarithm is what remains unknown about the entity once the term is seen. A term that
leaves less than ``GENERALISE_BITS`` gives the entity away there and is generalised, one
that leaves less than ``REMOVE_BITS`` is removed.

Rules for odd input: null text is the empty text and holds nothing; texts of any length
are searched whole, in time linear in their length; repeated rows get the same spans but
count once as evidence; an empty table gives an empty result; a null id is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textpace.llm.common import staged

# The patterns of the base kinds, made possessive so that they never go back,
# and anchored to the start of a run where a later start in it cannot match either.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# End of fixed values.
KINDS = (*PATTERNS, "term")
TERM = r"\p{L}[\p{L}\p{N}]{2,}"
# Code points of text on each side of an entity in which terms are sought.
REACH = 60
# Different texts in which a term must stand beside the entity.
MIN_TEXTS = 3
GENERALISE_BITS = 1.0
REMOVE_BITS = 0.15
PLACES = "array<struct<start:int,end:int,value:string>>"
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def places(text: Column, pattern: str) -> Column:
    """Non-overlapping matches, leftmost first, as structs (start, end, value) in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # The gap behind the last hit has none. Filtered rather than cut off, so that no pattern is searched for its count.
    pairs = F.filter(F.arrays_zip(hits.alias("hit"), gaps.alias("gap")), lambda p: p["hit"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(PLACES).alias("found"))

    def add(acc, pair):
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(
            begin.alias("start"), end.alias("end"), pair["hit"].alias("value")))).alias("found"))

    return F.aggregate(pairs, start, add)["found"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        digit = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All valid matches of the base kinds, by start and then kind."""
    text = F.coalesce(text, F.lit(""))
    # A cheap look first: most texts cannot hold the kind at all.
    may = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"),
           "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": F.contains(text, F.lit("+"))}

    def of_kind(rank, kind):
        good = F.filter(places(text, PATTERNS[kind]), lambda p: _valid(kind, p["value"]))
        shaped = F.transform(good, lambda p: F.struct(
            p["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            p["end"].alias("end"), p["value"].alias("value")))
        return F.when(may[kind], shaped).otherwise(F.array().cast(SPAN))

    return F.array_sort(F.concat(*[of_kind(r, k) for r, k in enumerate(PATTERNS)]))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def context_terms(text: Column, spans: Column) -> Column:
    """Terms near each span as structs (entity, term, start, end), outside all spans."""
    def around(span):
        left_at = F.greatest(span["start"] - REACH, F.lit(0))
        left = F.substring(text, left_at + 1, span["start"] - left_at)
        right = F.substring(text, span["end"] + 1, F.lit(REACH))
        whole_left = F.filter(places(left, TERM), lambda p: (left_at == 0) | (p["start"] > 0))
        whole_right = F.filter(places(right, TERM), lambda p: (F.length(right) < REACH) | (p["end"] < REACH))
        entity = F.concat(span["kind"], F.lit(":"), F.lower(span["value"]))

        def shaped(p, shift):
            return F.struct(entity.alias("entity"), F.lower(p["value"]).alias("term"),
                            (p["start"] + shift).alias("start"), (p["end"] + shift).alias("end"))
        return F.concat(F.transform(whole_left, lambda p: shaped(p, left_at)),
                        F.transform(whole_right, lambda p: shaped(p, span["end"])))

    near = F.flatten(F.transform(spans, around))
    return F.filter(near, lambda t: ~F.exists(spans, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))


def revealing(contexts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(entity, term, bits): pairs whose term leaves few bits unknown about the entity.

    ``contexts``: a row (text_hash, entity, term) for each place; ``corpus``: rows of text.
    """
    per_text = contexts.groupBy("entity", "term", "text_hash").agg(F.count("*").alias("n"))
    pairs = per_text.groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("n").alias("near")) \
        .where(F.col("texts") >= MIN_TEXTS)
    # Copies of a text weigh as often as they stand in the corpus on both sides of the share.
    words = corpus.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("term")) \
        .groupBy("term").agg(F.count("*").alias("times"))
    bits = -F.log2(F.least(F.col("near") / F.col("times"), F.lit(1.0)))
    return pairs.join(words, "term").select("entity", "term", bits.alias("bits")) \
        .where(F.col("bits") < GENERALISE_BITS)


def _searched(docs: DataFrame, *kept: str) -> DataFrame:
    """The kept columns with _hash of the text, its base spans and, where it has any, the terms near them.

    Staged, so that no later step searches a text again.
    """
    text = F.coalesce("text", F.lit(""))
    plain = docs.select(*kept, text.alias("_text"), F.xxhash64(text).alias("_hash")) \
        .withColumn("_base", base_spans(F.col("_text")))
    near = F.when(F.size("_base") > 0, context_terms(F.col("_text"), F.col("_base")))
    return staged(plain.select(*kept, "_hash", "_base", near.alias("_near")), "privacy-found")


def _with_terms(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, base, terms) from those of ``_searched``."""
    found = found.select("doc_id", F.col("_hash").alias("text_hash"), F.col("_base").alias("base"), F.col("_near").alias("near"))
    places_ = found.where("near is not null").select("doc_id", "text_hash", F.explode("near").alias("p")) \
        .select("doc_id", "text_hash", "p.*")
    flagged = places_.join(revealing(places_, corpus), ["entity", "term"]) \
        .groupBy("doc_id", "text_hash", "start", "end").agg(F.min("bits").alias("bits"), F.min("term").alias("term"))
    terms = flagged.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.array_sort(F.collect_list(F.struct(
        "start", F.lit(KINDS.index("term")).alias("rank"),
        F.when(F.col("bits") < REMOVE_BITS, "removed").otherwise("term").alias("kind"),
        "end", F.col("term").alias("value")))).alias("terms"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return found.join(terms, same, "left").select(
        "doc_id", "text_hash", "base", F.coalesce("terms", F.array().cast(SPAN)).alias("terms"))


def find(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, base, terms) for every document; spans as arrays of SPAN."""
    return _with_terms(_searched(docs, "doc_id"), docs)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    shown = F.transform(spans, lambda s: F.concat(
        F.when(s["rank"] == KINDS.index("term"), "term").otherwise(s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"]))
    return F.concat_ws(",", shown)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span as its kind in angle brackets, and removed terms gone."""
    def add(acc, s):
        kept = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        shown = F.when((s["start"] < acc["at"]) | (s["kind"] == "removed"), "") \
            .otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], kept, shown).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with personal data and revealing terms replaced; ``n_chars`` follows the text.

    Texts without any base span are untouched and take part in no join; each text is searched once.
    """
    found = _searched(docs, *docs.columns)
    spans = _with_terms(found, found).where(F.size("base") > 0).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_of"), "base", "terms") \
        .dropDuplicates(["_id", "_of"]).select("_id", "_of", F.array_sort(F.concat("base", "terms")).alias("_spans"))
    hit = found.where(F.size("_base") > 0)
    changed = hit.join(spans, hit["doc_id"].eqNullSafe(F.col("_id")) & (hit["_hash"] == F.col("_of")))
    new = {"text": redacted(F.col("text"), F.col("_spans"))}
    changed = changed.withColumns(new)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns).unionByName(found.where(F.size("_base") == 0).select(*docs.columns))
