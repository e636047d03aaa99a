"""Remove credentials from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.functions.text import SPACE, SPACE_RE2

# What counts as a credential, and what is left of it.
SECRET_PATTERNS = [
    (rf"(?i)(authorization:[{SPACE}]*bearer[{SPACE}]+)[A-Za-z0-9._\-]+", "$1***"),
    (rf"(?i)((?:api[_-]?key|password|secret|token)\"?[{SPACE}]*[:=][{SPACE}]*\"?)[^{SPACE}\",]+", "$1***"),
    (rf"(postgres(?:ql)?(?:\+[\p{{L}}\p{{N}}_]+)?://[^:/{SPACE}]+:)[^@{SPACE}]+(@)", "$1***$2"),
    (r"\bsk-[A-Za-z0-9_\-]{16,}\b", "***"),
]


def redact_secrets(text: Column) -> Column:
    for pattern, replacement in SECRET_PATTERNS:
        text = F.regexp_replace(text, "(?U)" + pattern, replacement)
    return text


def redact_sql(text: str) -> str:
    for pattern, replacement in SECRET_PATTERNS:
        pattern = pattern.replace(SPACE, SPACE_RE2)
        text = f"regexp_replace({text}, '{pattern}', '{replacement.replace('$', chr(92))}', 'g')"
    return text
