"""Auditing of answers and of the evidence behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions import lexicons as lx
from quayside.functions.text import collapse, strip
from quayside.operators.retrieval import escape_tags

# Sizes and messages.
ROWS_IN_EVIDENCE, RESULT_ROWS, LABEL_ROWS = 50, 200, 3
NOT_CITED = "The answer did not cite specific passages; all retrieved sources are listed."
UNKNOWN_SOURCES = "Removed citations to unknown sources: "
ISO_DATE = r"^\d{4}-\d{2}-\d{2}"
PLACEHOLDER = r"\{s\d+\}"


def grounding(route: Column, canned: Column, sources: Column, used: Column, removed: Column) -> Column:
    """Struct of grounded, the sources kept and the warnings of one answer.

    ``sources`` is an array of (id, type); type is "document" or "database"."""
    has_documents = F.exists(sources, lambda s: s["type"] == "document")
    cited = has_documents & (F.size(used) > 0)
    kept = F.when(cited, F.filter(sources, lambda s: (s["type"] == "database") | F.array_contains(used, s["id"]))).otherwise(sources)
    warnings = F.array_compact(F.array(
        F.when(F.size(removed) > 0, F.concat(F.lit(UNKNOWN_SOURCES), F.array_join(removed, ", "))),
        F.when(has_documents & ~cited & ~canned, NOT_CITED)))
    grounded = (
        F.when(canned | (route == "GENERAL"), False)
        .when(route == "SQL", F.exists(sources, lambda s: s["type"] == "database"))
        .otherwise(F.size(used) > 0)
    )
    return F.struct(grounded.alias("grounded"), kept.alias("sources"), warnings.alias("warnings"))


def database_evidence(result: DataFrame, order: list[Column], source_id: str, explanation: str, sql: str,
                      max_rows: int = RESULT_ROWS, shown: list[str] | None = None) -> DataFrame:
    """A query result as one text block; only the bounded result page is gathered."""
    page = _numbered(result.orderBy(*order).limit(max_rows + 1), order)
    names = shown or result.columns
    cells = [F.coalesce(escape_tags(F.col(n).cast("string")), F.lit("NULL")) for n in names]
    gathered = page.select("_at", F.concat_ws(" | ", *cells).alias("line"))
    rows = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("_at", "line"))), lambda x: x["line"]), 1, ROWS_IN_EVIDENCE)
    count = F.least(F.count("*"), F.lit(max_rows))
    truncated = F.count("*") > min(ROWS_IN_EVIDENCE, max_rows)
    block = F.concat(
        F.lit(f'<database_result id="{source_id}" rows="'), F.col("n"), F.lit('" truncated="'), F.col("truncated").cast("string"),
        F.lit('">\nWhat it computes: '), escape_tags(F.lit(explanation)), F.lit(f"\nSQL: {sql}\n{' | '.join(names)}\n"),
        F.when(F.size("rows") > 0, F.array_join("rows", "\n")).otherwise("(no rows)"), F.lit("\n</database_result>"))
    return gathered.agg(count.alias("n"), truncated.alias("truncated"), rows.alias("rows")).select(
        F.lit(source_id).alias("source_id"), F.col("n").alias("row_count"), "truncated", block.alias("evidence"))


def _numbered(page: DataFrame, order: list[Column]) -> DataFrame:
    """Positions of a page of few rows (never of a whole table)."""
    return page.withColumn("_at", F.row_number().over(Window.orderBy(*order)))


def entity_labels(result: DataFrame, order: list[Column], rows: int = LABEL_ROWS) -> DataFrame:
    """The first plain text value of each of the top rows, distinct, as one string."""
    texts = [f.name for f in result.schema.fields if isinstance(f.dataType, T.StringType)]
    top = result.orderBy(*order).limit(rows)
    usable = [F.when((strip(F.col(n)) != "") & ~F.col(n).rlike(ISO_DATE), strip(F.col(n))) for n in texts]
    label = F.coalesce(*usable) if usable else F.lit(None).cast("string")
    listed = F.array_distinct(F.filter(F.transform(
        F.array_sort(F.collect_list(F.struct("_at", "label"))), lambda x: x["label"]), lambda v: v.isNotNull()))
    numbered = _numbered(top, order).select("_at", label.alias("label"))
    return numbered.agg(F.array_join(listed, ", ").alias("labels"))


def resolve_template(template: Column, labels: Column, step: str = "s1") -> Column:
    """Put the labels of a finished step into the next step's query."""
    slot = "{" + step + "}"
    named = F.when(template.contains(slot), F.replace(template, F.lit(slot), F.coalesce(labels, F.lit(""))))
    named = named.when(labels != "", F.concat(template, F.lit(" ("), labels, F.lit(")"))).otherwise(template)
    return collapse(F.regexp_replace(named, PLACEHOLDER, ""))


def fallback_case(route: Column, database_results: Column, failures: Column, passages: Column) -> Column:
    """Which fixed reply an answer without evidence gets; null where there is evidence."""
    return (
        F.when((route == "SQL") & (database_results == 0), F.when(failures > 0, "sql_failed").otherwise("no_data"))
        .when((route == "RAG") & (passages == 0), "no_documents")
        .when((route == "HYBRID") & (database_results == 0) & (passages == 0), "nothing_found")
    )


def fallback_reply(case: Column, language: Column, reason: Column) -> Column:
    """Localised reply; English replies carry the reason."""
    entries = [F.lit(x) for key, texts in lx.REPLIES.items() for lang, text in texts.items() for x in (f"{key}/{lang}", text)]
    replies = F.create_map(*entries)
    code = F.when(language == "mixed", "bn").otherwise(language)
    text = F.coalesce(F.try_element_at(replies, F.concat(case, F.lit("/"), code)),
                      F.try_element_at(replies, F.concat(case, F.lit("/en"))))
    return F.when((reason != "") & (code == "en"), F.concat(text, F.lit("\n\n_"), reason, F.lit("_"))).otherwise(text)
