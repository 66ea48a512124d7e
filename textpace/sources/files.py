"""File sources: decoding, format routing, titles and table scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textpace.functions.words import is_blank

# --- fixed values: extension to reader ---
FORMATS = {
    "txt": "text", "md": "markdown", "markdown": "markdown", "fb2": "fb2", "epub": "epub",
    "docx": "docx", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "heic": "image",
    "tiff": "image", "bmp": "image", "gif": "image",
}
# --- end of fixed values ---


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def format_of(path: Column) -> Column:
    """Reader family of a path; null when unsupported."""
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.try_element_at(known, extension(path))


def title_of(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def decode_texts(files: DataFrame) -> DataFrame:
    """Text of file bytes: UTF-8 where valid, else Latin-1. Blank documents are dropped."""
    raw = F.col("content")
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(
        F.decode(raw, "ISO-8859-1"))
    return files.select("path", title_of(F.col("path")).alias("title"), text.alias("text")).where(
        ~is_blank(F.col("text")))


def scan_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", glob).load(path)
    return decode_texts(files)


def markdown_texts(files: DataFrame) -> DataFrame:
    """Title and raw text of Markdown files given as path and text; blank files are dropped."""
    return files.select("path", title_of(F.col("path")).alias("title"), "text").where(~is_blank(F.col("text")))


def scan_markdown(spark: SparkSession, path: str, glob: str = "*.{md,markdown}") -> DataFrame:
    """Whole Markdown files of a folder tree."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(
        path, wholetext=True)
    return markdown_texts(rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def route(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Supported files with their format, and the rejected rest."""
    tagged = files.withColumn("format", format_of(F.col("path")))
    return tagged.where(F.col("format").isNotNull()), tagged.where(F.col("format").isNull()).drop("format")


# A line of page layout: required columns with their types, and the tests a row has to pass.
LAYOUT = {
    "doc_id": "bigint", "page": "int", "line_idx": "int", "text": "string",
    "x_min": "double", "x_max": "double", "y_min": "double", "y_max": "double", "font_size": "double",
}
LAYOUT_RULES = {
    "no document": "doc_id IS NULL", "no page": "page IS NULL OR page < 0", "no line": "line_idx IS NULL",
    "no text": "text IS NULL", "no box": "x_min IS NULL OR x_max IS NULL OR y_min IS NULL OR y_max IS NULL",
    "box not finite": "NOT (abs(x_min) < 1e308 AND abs(x_max) < 1e308 AND abs(y_min) < 1e308 AND abs(y_max) < 1e308)",
    "box turned over": "x_min > x_max OR y_min > y_max",
    "no font size": "font_size IS NULL OR NOT (font_size > 0 AND font_size < 1e308)",
}


def check_layout(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that keep the contract, in its types, and the rejected rows with the first reason.

    A missing column or a type that cannot be read as the required one is an error of the whole
    table and is raised before any row is read. A value that the required type cannot hold
    (a text that is no number, a page beyond the type) rejects its row. Further columns pass through.
    """
    kinds = {f.name: f.dataType for f in lines.schema}
    missing = [c for c in LAYOUT if c not in kinds]
    nested = [c for c in LAYOUT if c in kinds and kinds[c].typeName() in ("array", "map", "struct", "binary")]
    if missing or nested:
        raise ValueError(f"layout lines lack {missing} and cannot read {nested}")
    typed = lines.select(
        *[F.col(c).try_cast(t).alias(c) for c, t in LAYOUT.items()],
        *[F.col(c) for c in lines.columns if c not in LAYOUT],
        F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(f"bad {c}"))
                                  for c, t in LAYOUT.items()])).alias("_bad"))
    reason = F.coalesce(F.try_element_at("_bad", F.lit(1)),
                        *[F.when(F.expr(test), F.lit(name)) for name, test in LAYOUT_RULES.items()])
    tagged = typed.withColumn("reason", reason).drop("_bad")
    return tagged.where("reason IS NULL").drop("reason"), tagged.where("reason IS NOT NULL")


def scan_layout(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Layout or recognised-text lines kept as Parquet: good lines and rejected rows."""
    return check_layout(spark.read.parquet(path))
