"""Citation markers in answers: "[S1]" for passages, "[DB1]" for database results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.functions.text import SPACE, let, strip

# The forms a citation takes.
IDENTIFIER = r"(?:S|DB)\d+"
HIDDEN = rf"(?U)<!--[{SPACE}]*((?:\[[^\]]{{1,40}}\][{SPACE}]*)*\[[^\]]{{1,40}}\])[{SPACE}]*-->"
FULL_WIDTH = rf"(?iU)【[{SPACE}]*({IDENTIFIER})[^】]{{0,20}}】"
COMMENT = r"(?s)<!--.*?-->"
GROUP = rf"(?iU)\[[{SPACE}]*({IDENTIFIER}(?:[{SPACE}]*[,;][{SPACE}]*{IDENTIFIER})*)[{SPACE}]*\]"
SINGLE = r"\[(?:S\d+|DB\d+)\]"
SPACE_BEFORE_MARK = r"[ \t]+([.,;:!?।])"


def _ids(group: Column) -> Column:
    return F.transform(F.split(group, "[,;]"), lambda part: F.upper(strip(part)))


def validate_citations(text: Column, valid_ids: Column) -> Column:
    """Struct of the cleaned text, the ids used (distinct, in order) and the ids removed.

    The text is cut at its marker groups; the groups are rewritten one by one and put
    back between the parts."""
    shown = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, HIDDEN, "$1"), FULL_WIDTH, "[$1]"), COMMENT, "")

    def rewrite(plain: Column) -> Column:
        groups = F.transform(F.regexp_extract_all(plain, F.lit(GROUP), F.lit(1)), _ids)

        def check(found: Column) -> Column:
            known = lambda source: F.array_contains(valid_ids, source)
            kept = F.transform(found, lambda ids: F.array_join(
                F.transform(F.filter(ids, known), lambda i: F.concat(F.lit("["), i, F.lit("]"))), ""))
            parts = F.zip_with(F.split(plain, GROUP), kept, lambda part, marker: F.concat(part, F.coalesce(marker, F.lit(""))))
            cited = F.flatten(found)
            return F.struct(
                strip(F.regexp_replace(F.array_join(parts, ""), SPACE_BEFORE_MARK, "$1")).alias("text"),
                F.array_distinct(F.filter(cited, known)).alias("used"),
                F.filter(cited, lambda i: ~known(i)).alias("removed"))

        return let(groups, check)

    return let(shown, rewrite)


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, SINGLE, "")


def strip_citations_for_display(text: Column) -> Column:
    """Without markers and the blanks they leave."""
    plain = F.regexp_replace(strip_citations(text), SPACE_BEFORE_MARK, "$1")
    return strip(F.regexp_replace(plain, r"[ \t]{2,}", " "))
