"""Document files: reading, validating, naming, and rows turned into passages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quayside.functions.text import BENGALI, strip, words

# File extension to source type.
SOURCE_TYPES = {"pdf": "pdf", "docx": "docx", "txt": "txt", "md": "markdown", "markdown": "markdown", "csv": "csv"}
TEXT_TYPES = ["txt", "markdown", "csv"]
NUL_WINDOW = 4096  # bytes of a text file searched for a NUL byte
# Messages of rejected and failed files.
UNSUPPORTED = "Unsupported file type."
EMPTY = "The uploaded file is empty."
TOO_LARGE = "File exceeds the size limit."
BAD_PDF = "The file does not look like a valid PDF."
BAD_DOCX = "The file is not a valid DOCX document."
BINARY_TEXT = "Text files must not contain binary data."
NOT_UTF8 = "Text files must be UTF-8 encoded."


def extension(path: Column) -> Column:
    """Lower-case extension of the last path component, null without one."""
    name = F.element_at(F.split(path, "/"), -1)
    found = F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)\z", 1))
    return F.when(found != "", found)


def source_type(path: Column) -> Column:
    pairs = [F.lit(x) for pair in SOURCE_TYPES.items() for x in pair]
    return F.element_at(F.create_map(*pairs), extension(path))


@F.pandas_udf(StringType())
def _utf16(content: pd.Series) -> pd.Series:
    """UTF-16 with optional byte order mark; null where the bytes are no such text.

    Only files that are not UTF-8 arrive here with a value."""

    def decode(data):
        if data is None:
            return None
        try:
            return bytes(data).decode("utf-16")
        except UnicodeDecodeError:
            return None

    return content.map(decode)


def decode_text(content: Column) -> Column:
    """UTF-8 (byte order mark dropped), else UTF-16, else null."""
    as_text = content.cast("string")
    is_utf8 = F.is_valid_utf8(as_text)
    fallback = _utf16(F.when(~is_utf8, content))
    return F.when(is_utf8, F.regexp_replace(as_text, r"^\x{feff}", "")).otherwise(fallback)


def decode_corpus(files: DataFrame) -> DataFrame:
    """(path, content) rows to text rows; failures keep their row and a reason."""
    kind = source_type(F.col("path"))
    readable = kind.isin(*TEXT_TYPES)
    text = decode_text(F.when(readable, F.col("content")))
    return files.withColumn("source_type", kind).withColumn("text", text).withColumn(
        "error", F.when(kind.isNull(), UNSUPPORTED)
        .when(~F.col("source_type").isin(*TEXT_TYPES), F.concat(F.lit("No reader for "), "source_type"))
        .when(F.col("text").isNull(), NOT_UTF8))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """All files under a folder as (path, source_type, text, error) rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return decode_corpus(files.select("path", "content")).drop("content")


def validation_error(path: Column, content: Column, max_bytes: int) -> Column:
    """Message of the first failing rule, null for an acceptable file."""
    kind = source_type(path)
    size = F.octet_length(content)
    head = F.hex(F.substring(content, 1, 8))
    zip_entry = F.hex(F.encode(F.lit("word/document.xml"), "UTF-8"))
    # Two hex digits per byte: a NUL byte is "00" at an even offset.
    nul = F.hex(F.substring(content, 1, NUL_WINDOW)).rlike("^(?:..)*?00")
    utf16_mark = head.startswith("FFFE") | head.startswith("FEFF")
    docx = head.startswith("504B0304") & F.hex(content).contains(zip_entry)
    return (
        F.when(kind.isNull(), UNSUPPORTED)
        .when(size == 0, EMPTY)
        .when(size > max_bytes, TOO_LARGE)
        .when((kind == "pdf") & ~head.startswith("255044462D"), BAD_PDF)
        .when((kind == "docx") & ~docx, BAD_DOCX)
        .when(kind.isin(*TEXT_TYPES) & nul & ~utf16_mark, BINARY_TEXT)
    )


def validate_files(files: DataFrame, max_bytes: int) -> DataFrame:
    error = validation_error(F.col("path"), F.col("content"), max_bytes)
    return files.withColumn("source_type", source_type(F.col("path"))).withColumn("error", error)


def sanitize_filename(name: Column) -> Column:
    """Last path component with unusual characters replaced, never empty, 200 at most."""
    path = F.regexp_replace(F.regexp_replace(name, r"\\", "/"), r"(?:/+\.?)+\z", "")
    base = F.element_at(F.split(path, "/"), -1)
    safe = F.regexp_replace(base, rf"[^\p{{L}}\p{{N}}_.\- (){BENGALI}]+", "_")
    safe = F.regexp_replace(safe, r"^[ .]+|[ .]+\z", "")
    return F.substring(F.when(safe == "", "document").otherwise(safe), 1, 200)


def title_from_filename(name: Column) -> Column:
    """Stem with separators as blanks; words without capitals get one."""
    stem = F.regexp_replace(name, r"(?s)^(.+)\.[^.]+\z", "$1")
    spaced = strip(F.translate(stem, "_-", "  "))
    return F.array_join(F.transform(words(spaced), lambda w: F.when(
        (w == F.lower(w)) & (w != F.upper(w)), F.initcap(w)).otherwise(w)), " ")


def rows_to_passages(df: DataFrame, columns: list[str] | None = None, name: str = "passage") -> DataFrame:
    """Each row as "header: value; header: value", empty values left out."""
    parts = []
    for column in columns or df.columns:
        value = F.col(column).cast("string")
        parts.append(F.when(value != "", F.concat(F.lit(column.strip() + ": "), strip(value))))
    passage = F.concat_ws("; ", *parts)
    return df.withColumn(name, passage).filter(F.col(name) != "")


def read_csv_passages(spark: SparkSession, path: str) -> DataFrame:
    return rows_to_passages(spark.read.option("header", "true").csv(path))
