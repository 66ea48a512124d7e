"""The training-data pipeline over documents.

Each stage works on all rows its predecessor kept, and its decisions take effect: a stage
drops or rewrites documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textpace.llm import decontamination, langid, mixing, privacy, shingle_join
from textpace.llm.common import scan, staged


# A text shorter than this is too little evidence to reject it as ambiguous.
JUDGED_CHARS = 200
# Words of a shingle, and the similarity in hundredths from which documents are near copies.
NEAR_WORDS = 5
NEAR_SIMILAR = 80


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach; undetermined and long ambiguous ones go."""
    known = langid.predict(docs, langid.fit(docs))
    mixed = F.col("ambiguous") & (F.length("text") >= JUDGED_CHARS)
    return known.where((F.col("lang_pred") != langid.UNKNOWN) & ~mixed).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of similar ones."""
    return shingle_join.representatives(docs, NEAR_SIMILAR, NEAR_WORDS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, scan(spark, sf_dir, "benchmark"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that give it away replaced."""
    return privacy.sanitise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What each document gives to the mix: size, source_size, target, taken."""
    return mixing.mix(docs).ledger


STAGES = [
    ("language_id", identified),
    ("shingle_join", distinct),
    ("decontamination", decontaminated),
    ("privacy", sanitised),
    ("mix_sources", mixed),
]
# Learned and pseudorandom steps have no SQL form; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
