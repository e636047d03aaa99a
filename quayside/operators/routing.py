"""Routing decisions over logged questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.intent import is_follow_up
from quayside.operators.carry import last_before

# Thresholds of the safeguards.
STRONG_MATCH, POLICY_MATCH = 0.55, 0.35
FALLBACK_CAP, AGREEMENT_CAP, DOCUMENT_CAP = 0.7, 0.99, 0.7
SURE, AGGREGATION, CLARIFY = 0.6, 1.0, 0.4


def inherit_subject(messages: DataFrame, key: str, order: str) -> DataFrame:
    """User messages; a follow-up is prefixed with the previous user message."""
    said = F.when(F.col("role") == "user", F.col("text"))
    rows = last_before(messages, [key], order, said, "previous").filter("role = 'user'")
    follows = is_follow_up(F.col("text")) & F.col("previous").isNotNull()
    signal = F.when(follows, F.concat("previous", F.lit(" "), "text")).otherwise(F.col("text"))
    return rows.withColumn("inherited", follows).withColumn("signal_text", signal)


def heuristic_fallback(route: Column, confidence: Column, relevance: Column) -> tuple[Column, Column]:
    """Route and confidence when no model decided."""
    final = F.when((route == "GENERAL") & (relevance >= STRONG_MATCH), "RAG").otherwise(route)
    return final, F.least(confidence, F.lit(FALLBACK_CAP))


def fuse_route(df: DataFrame, digits: int = 3) -> DataFrame:
    """Model decision checked against the keyword signals, document match and inventory.

    Reads model_route, model_confidence, heuristic_route, heuristic_confidence, db_score,
    relevance, documents, asks_clarification; adds route, confidence, overrides, source,
    needs_clarification."""
    c = F.col
    model, guess, sure = c("model_route"), c("heuristic_route"), c("heuristic_confidence")
    company = (model == "GENERAL") & (guess != "GENERAL") & (sure >= SURE)
    matched = ~company & (model == "GENERAL") & (c("relevance") >= STRONG_MATCH + 0.1)
    policy = (
        ~company & ~matched & model.isin("SQL", "HYBRID") & (guess == "RAG")
        & (c("db_score") < AGGREGATION) & (c("relevance") >= POLICY_MATCH)
    )
    route = F.when(company, guess).when(matched | policy, "RAG").otherwise(model)
    capped = (
        F.when(company | policy, F.least(c("model_confidence"), sure))
        .when(matched, F.least(c("model_confidence"), F.lit(DOCUMENT_CAP)))
        .otherwise(c("model_confidence"))
    )
    df = df.withColumn("_company", company).withColumn("_matched", matched).withColumn("_policy", policy)
    df = df.withColumn("_route", route).withColumn("_confidence", capped)
    empty = (c("_route") == "HYBRID") & (c("documents") == 0)
    df = df.withColumn("_empty", empty).withColumn("route", F.when(empty, "SQL").otherwise(c("_route")))
    confidence = (
        F.when(c("route") == guess, F.least(F.lit(AGREEMENT_CAP), 0.75 * c("_confidence") + 0.25))
        .when((guess != "GENERAL") & (sure >= SURE), c("_confidence") * 0.85)
        .otherwise(c("_confidence"))
    )
    reasons = F.filter(F.array(
        F.when(c("_company"), F.concat(F.lit("company-data signals point to "), guess)),
        F.when(c("_matched"), "a knowledge-base document closely matches the question"),
        F.when(c("_policy"), "no data aggregation requested and a policy document matches"),
        F.when(c("_empty"), "knowledge base is empty, using the database only"),
    ), lambda r: r.isNotNull())
    return (
        df.withColumn("_c", confidence)
        .withColumn("overrides", F.array_join(reasons, "; "))
        .withColumn("source", F.when(F.size(reasons) > 0, "llm+safeguard").otherwise("llm"))
        .withColumn("needs_clarification", c("asks_clarification") & (c("_c") < CLARIFY))
        .withColumn("confidence", F.round("_c", digits))
        .drop("_company", "_matched", "_policy", "_route", "_confidence", "_empty", "_c")
    )
