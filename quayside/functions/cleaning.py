"""Text normalisation before chunking."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quayside.functions.text import strip

# What is deleted, collapsed and joined.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{200b}\x{feff}]"
BLANKS = r"[ \t\x{a0}\x{2009}\x{202f}]+"
HYPHEN_BREAK = r"([A-Za-z])-\n([a-z])"
EMPHASIS = r"(\*\*|__)([^\n]+?)\1"
COMMENT = r"(?s)<!--.*?-->"
# White space (but no line feed) beside a line feed; the characters below U+0020 are gone by then.
LINE_EDGES = r"(?U)(?<=\n)[\s&&[^\n]]+|[\s&&[^\n]]+(?=\n)"
# No character below U+0300 changes under NFC or starts a composition.
MAY_COMPOSE = r"[^\x00-\x{2ff}]"


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def nfc(text: Column) -> Column:
    """Unicode NFC. Spark has no function for it; only texts that may change reach Python."""
    needed = text.rlike(MAY_COMPOSE)
    return F.when(needed, _nfc(F.when(needed, text))).otherwise(text)


def strip_markdown(text: Column) -> Column:
    """Without bold markers and HTML comments."""
    return F.regexp_replace(F.regexp_replace(text, EMPHASIS, "$2"), COMMENT, "")


def tidy(text: Column, markdown: bool = False) -> Column:
    """Everything but the Unicode step: line ends, control characters, blanks, empty lines."""
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.regexp_replace(text, CONTROL, "")
    text = F.regexp_replace(text, HYPHEN_BREAK, "$1$2")
    if markdown:
        text = strip_markdown(text)
    text = F.regexp_replace(text, BLANKS, " ")
    text = F.regexp_replace(text, LINE_EDGES, "")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def clean_text(text: Column, markdown: bool = False) -> Column:
    return tidy(nfc(text), markdown)
