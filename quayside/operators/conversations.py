"""Conversation lists, titles, bounded history, and clean-up of unanswered messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.text import collapse, shorten

# Sizes of titles and history lines.
TITLE_CHARS, TITLE_KEEP = 60, 57
MESSAGE_CHARS, SQL_CHARS = 500, 400
HISTORY_MESSAGES, HISTORY_CHARS = 8, 6000


def conversation_list(headers: DataFrame, messages: DataFrame, key: str, newest: Column, limit: int = 100) -> DataFrame:
    """Newest conversations with their message counts; those without messages are hidden."""
    counts = messages.groupBy(key).agg(F.count("*").alias("messages"))
    return headers.join(counts, key).orderBy(newest, F.desc(key)).limit(limit)


def title_of(message: Column) -> Column:
    text = collapse(message)
    cut = F.concat(F.rtrim(F.substring(text, 1, TITLE_KEEP)), F.lit("..."))
    return F.when(F.length(text) <= TITLE_CHARS, text).otherwise(cut)


def conversation_titles(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Title from the first user message; the minimum is combined before the shuffle."""
    first = messages.filter("role = 'user'").groupBy(key).agg(F.min_by("text", order).alias("text"))
    return first.select(key, title_of(F.col("text")).alias("title"))


def recent_messages(messages: DataFrame, key: str, order: str, n: int = HISTORY_MESSAGES) -> DataFrame:
    """The last n messages per conversation; Spark keeps only n per key before the shuffle."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= n)


def history_line(role: Column, text: Column, route: Column, sql: Column) -> Column:
    """ "User: ..." or "Assistant: ... [route=...; SQL: ...; SQL: ...]", long contents cut.

    ``sql`` is an array: all statements of the message, of which null and empty ones are left out."""
    content = shorten(collapse(text), MESSAGE_CHARS)
    statements = F.filter(F.transform(sql, lambda x: F.substring(collapse(x), 1, SQL_CHARS)), lambda x: x != "")
    extras = F.concat_ws("; ", F.when(route != "", F.concat(F.lit("route="), route)),
                         F.transform(statements, lambda x: F.concat(F.lit("SQL: "), x)))
    suffix = F.when(extras != "", F.concat(F.lit(" ["), extras, F.lit("]"))).otherwise("")
    return F.when(role == "user", F.concat(F.lit("User: "), content)).otherwise(
        F.concat(F.lit("Assistant: "), content, suffix))


def history_window(messages: DataFrame, key: str, order: str, line: Column,
                   n: int = HISTORY_MESSAGES, max_chars: int = HISTORY_CHARS) -> DataFrame:
    """History text per conversation: newest lines first until the budget is full.

    Only the last n messages of a conversation are ever grouped, so groups stay small
    whatever the length of the conversation."""
    lines = recent_messages(messages, key, order, n).select(key, "recency", line.alias("line"))
    spent = F.sum(F.length("line")).over(
        Window.partitionBy(key).orderBy("recency").rowsBetween(Window.unboundedPreceding, 0))
    kept = lines.withColumn("spent", spent).filter(F.col("spent") <= max_chars)
    ordered = F.sort_array(F.collect_list(F.struct("recency", "line")), asc=False)
    return kept.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("history"),
        F.count("*").alias("lines"))


def drop_unanswered(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Without the last message of conversations whose run failed after a user message."""
    last = messages.groupBy(key).agg(F.max(F.struct(order, "role")).alias("last"))
    failed = last.filter("last.role = 'user'").select(key, f"last.{order}")
    return messages.join(failed, [key, order], "left_anti")
