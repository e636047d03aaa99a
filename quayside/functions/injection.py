"""Instruction-like phrases inside documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.functions.text import SPACE, let

MAX_MARKERS, MARKER_CHARS = 5, 80

# Phrases that mark a text as suspicious (\s stands for any white space).
PHRASES = [
    r"ignore\s+(all\s+|any\s+)?(the\s+)?(previous|prior|above|earlier)\s+(instructions|prompts|rules)",
    r"disregard\s+(all\s+|the\s+)?(previous|prior|above|system)",
    r"forget\s+(all\s+|your\s+)?(previous\s+)?instructions",
    r"you\s+are\s+now\s+(a|an|in)\b",
    r"(reveal|print|show|output|leak)\s+(the\s+|your\s+)?(system\s+prompt|instructions|password|credentials|api\s+key|secret)",
    r"(system|developer)\s+prompt",
    r"developer\s+mode|jailbreak|\bDAN\b",
    r"</?\s*(system|assistant|document|instructions?)\s*>",
    r"(drop|delete|truncate)\s+(table|database)",
    r"(execute|run)\s+(this\s+)?(sql|query|command)",
    r"আগের\s+নির্দেশ(না)?\s+(উপেক্ষা|ভুলে)",
]
PATTERN = "(?iU)" + "|".join(f"(?:{p})" for p in PHRASES).replace(r"\s", f"[{SPACE}]")


# Letters that equal i, k or s when case is ignored, though lower-casing keeps them apart.
FOLDED, FOLDS_TO = "İıKſ", "iiks"
# One by one on folded text: no letter case to try, and no alternatives at every character,
# which is about twice as fast on texts without any such phrase.
QUICK = ["(?U)" + p.lower().replace(r"\s", f"[{SPACE}]") for p in PHRASES]
# Each phrase holds one of these: a text without them isn't searched for it.
NEEDED = [
    ["ignore"], ["disregard"], ["forget"], ["now"], ["system", "instructions", "password", "credentials", "api", "secret"], ["prompt"],
    ["developer", "jailbreak", "dan"], ["<"], ["table", "database"], ["sql", "query", "command"], ["নির্দেশ"],
]


def is_suspicious(text: Column) -> Column:
    """Whether ``PATTERN`` finds anything."""
    folded = F.lower(F.when(text.rlike(f"[{FOLDED}]"), F.translate(text, FOLDED, FOLDS_TO)).otherwise(text))

    def searched(folded: Column) -> Column:
        found = [reduce(Column.__or__, [folded.contains(x) for x in needed]) & folded.rlike(p) for needed, p in zip(NEEDED, QUICK, strict=True)]
        return reduce(Column.__or__, found)

    return let(folded, searched)


def injection_markers(text: Column) -> Column:
    """The first phrases found, each shortened; the quick test spares clean texts the search."""
    found = F.slice(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), 1, MAX_MARKERS)
    shortened = F.transform(found, lambda m: F.substring(m, 1, MARKER_CHARS))
    return F.when(is_suspicious(text), shortened).otherwise(F.array().cast("array<string>"))
