"""Language and intent of questions, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions import lexicons as lx
from quayside.functions.text import BENGALI, BENGALI_DIGITS, SPACE, collapse, let, lit_array

# --- language ------------------------------------------------------------------------------


def bengali_ratio(text: Column) -> Column:
    """Share of Bengali characters among all Latin and Bengali letters."""
    bengali = F.regexp_count(text, F.lit(f"[{BENGALI}]"))
    letters = F.regexp_count(text, F.lit(f"[A-Za-z{BENGALI}]"))
    return F.when(letters > 0, F.round(bengali / letters, 3)).otherwise(0.0)


def detect_language(text: Column) -> Column:
    """en, bn, banglish (Bengali in Latin letters) or mixed."""
    bengali = F.regexp_count(text, F.lit(f"[{BENGALI}]"))
    letters = F.regexp_count(text, F.lit(f"[A-Za-z{BENGALI}]"))
    latin = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    lexicon = lit_array(sorted(lx.BANGLISH))
    hits = F.size(F.filter(latin, lambda w: F.array_contains(lexicon, w)))
    n = F.size(latin)
    return (
        F.when((bengali > 0) & (bengali / letters >= 0.85) & (n <= 1), "bn")
        .when(bengali > 0, "mixed")
        .when((hits >= 2) & (hits / n >= 0.25), "banglish")
        .when((hits == 1) & (n <= 3), "banglish")
        .otherwise("en")
    )


def detect_script(text: Column) -> Column:
    return F.when(text.rlike(f"[{BENGALI}]"), "bengali").otherwise("latin")


def normalise_answer(text: Column) -> Column:
    """Bengali digits to ASCII, lower case, white space collapsed."""
    return collapse(F.lower(F.translate(text, BENGALI_DIGITS, "0123456789")))


# --- keyword signals -------------------------------------------------------------------------

MARK = chr(1)
EDGE = "(?<![a-z0-9])(?=[a-z0-9])|(?<=[a-z0-9])(?![a-z0-9])"


def mark_words(text: Column) -> Column:
    """Lower-case text with a mark at both ends of every run of a-z and 0-9.

    A marked term is found as a plain substring exactly where no such character touches
    it, so one regular expression per text replaces one per term."""
    return F.regexp_replace(F.lower(text), EDGE, MARK)


def _marked(term: str) -> str:
    return re.sub(EDGE, MARK, term)


def count_hits(marked: Column, terms: list[str]) -> Column:
    """Number of list entries found in a marked text (bind it with ``let`` first)."""
    keys = lit_array([_marked(t) for t in terms])  # entries without a-z0-9 stay as they are
    return F.size(F.filter(keys, lambda term: F.contains(marked, term)))


def keyword_hits(text: Column, terms: list[str]) -> Column:
    """Number of list entries in the text; ASCII entries must stand alone."""
    return let(mark_words(text), lambda marked: count_hits(marked, terms))


def hits_per_table(text: Column) -> Column:
    """Keyword hits for every business table, as one struct."""
    return let(mark_words(text), lambda marked: F.struct(
        *[count_hits(marked, terms).alias(name) for name, terms in lx.TABLE_TERMS.items()]))


def _normalised(text: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), rf"(?U)[{SPACE}]+", " "), F.lit(" "))


def intent_signals(text: Column, company: tuple[str, ...] = ()) -> Column:
    """Keyword signals of a question as a struct. ``company`` adds names the company goes by."""

    def signals(padded: Column, marked: Column) -> Column:
        tables = F.array(*[F.when(count_hits(marked, terms) > 0, name) for name, terms in lx.TABLE_TERMS.items()])
        return F.struct(
            F.array_compact(tables).alias("tables"),
            count_hits(marked, lx.ANALYTICS_TERMS).alias("analytics"),
            count_hits(marked, lx.DOCUMENT_TERMS).alias("documents"),
            count_hits(marked, lx.COMPANY_TERMS + list(company)).alias("company"),
            count_hits(marked, lx.GENERAL_TERMS).alias("general"),
            reduce(Column.__or__, [F.contains(padded, F.lit(c)) for c in lx.CONJUNCTIONS]).alias("joined"))

    return let(_normalised(text), lambda padded: let(mark_words(padded), lambda marked: signals(padded, marked)))


def intent_from_signals(s: Column) -> Column:
    """Struct of db_score, doc_score, route and confidence."""
    tables, analytics, documents, company = s["tables"], s["analytics"], s["documents"], s["company"]
    general, joined = s["general"], s["joined"]
    n = F.size(tables)
    db = F.when(n == 0, 0.0).when(analytics > 0, n * 0.6 + analytics).otherwise(n * 0.4)
    doc = documents + F.when((company > 0) & (documents > 0), 0.5).otherwise(0.0)
    hybrid = (db >= 1.5) & (doc >= 1.0) & (joined | (doc >= 2))
    sql = (db > doc) & (db >= 1.0)
    route = (
        F.when(hybrid, "HYBRID").when(sql, "SQL").when((doc >= 1.0) | (company > 0), "RAG").otherwise("GENERAL")
    )
    confidence = (
        F.when(hybrid, 0.55 + F.least(F.lit(0.3), 0.05 * (db + doc)))
        .when(sql, 0.5 + F.least(F.lit(0.4), 0.1 * (db - doc + 1)))
        .when(doc >= 1.0, 0.5 + F.least(F.lit(0.4), 0.1 * (doc - db + 1)))
        .when(company > 0, 0.45)
        .otherwise(0.5 + F.least(F.lit(0.3), 0.1 * general))
    )
    return F.struct(
        F.round(db, 2).alias("db_score"), F.round(doc, 2).alias("doc_score"), route.alias("route"),
        F.round(F.least(confidence, F.lit(0.9)), 3).alias("confidence"))


def with_intent(df: DataFrame, text: Column, company: tuple[str, ...] = ()) -> DataFrame:
    """Add matched tables, general score, scores, route and confidence."""
    return (
        df.withColumn("_s", intent_signals(text, company))
        .withColumn("_i", intent_from_signals(F.col("_s")))
        .withColumns({
            "matched_tables": F.col("_s.tables"), "general_score": F.col("_s.general").cast("double"),
            "db_score": F.col("_i.db_score"), "doc_score": F.col("_i.doc_score"),
            "route": F.col("_i.route"), "confidence": F.col("_i.confidence")})
        .drop("_s", "_i")
    )


FOLLOW_UP = rf"(?iU)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(lx.FOLLOW_UPS)})(?![\p{{L}}\p{{N}}_])"


def is_follow_up(text: Column) -> Column:
    return text.rlike(FOLLOW_UP)
