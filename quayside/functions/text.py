"""Small text expressions shared by the operators (all JVM-side).

Code points are written as ``\\x{...}``, which Spark and the checking engine both read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space. Spark's patterns start with
# (?U), where \s is one Unicode property test; the checking engine needs the list.
SPACE = r"\s\x1c-\x1f"
SPACE_RE2 = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The Bengali block.
BENGALI = r"\x{980}-\x{9ff}"
BENGALI_DIGITS = "০১২৩৪৫৬৭৮৯"



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it several times, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


SCAN_BLOCK = 128


def scan(items: Column, state: Column, step: Callable[[Column, Column], Column], emits: str,
         finish: Callable[[Column, Column], Column]) -> Column:
    """Walk through an array with a state of bounded size, emitting one value (or null) an element.

    ``step(state, item)`` gives ``struct(state, emit)``, ``finish(state, emitted)`` the result. A fold that
    appends to its accumulator copies it at every step; here only a block's values are copied, and the blocks
    are joined once at the end, so the time grows with the array's length."""
    none, no_blocks = F.array().cast(f"array<{emits}>"), F.array().cast(f"array<array<{emits}>>")

    def one(acc: Column, item: Column) -> Column:
        return let(step(acc["state"], item), lambda s: F.struct(
            s["state"].alias("state"), F.array_append(acc["out"], s["emit"]).alias("out")))

    def over(whole: Column) -> Column:
        def block(acc: Column, at: Column) -> Column:
            walked = F.aggregate(F.slice(whole, at, SCAN_BLOCK), F.struct(acc["state"].alias("state"), none.alias("out")), one)
            return let(walked, lambda w: F.struct(w["state"].alias("state"), F.array_append(acc["out"], w["out"]).alias("out")))

        starts = F.when(F.size(whole) > 0, F.sequence(F.lit(1), F.size(whole), F.lit(SCAN_BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(starts, F.struct(state.alias("state"), no_blocks.alias("out")), block,
                           lambda acc: finish(acc["state"], F.flatten(acc["out"])))

    return let(items, over)


def strip(text: Column) -> Column:
    """Remove white space at both ends (``trim`` knows the plain blank only)."""
    return F.regexp_replace(text, rf"(?U)^[{SPACE}]+|[{SPACE}]+\z", "")


def collapse(text: Column) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return F.btrim(F.regexp_replace(text, rf"(?U)[{SPACE}]+", " "))


def shorten(text: Column, limit: int, ellipsis: str = "…") -> Column:
    """Text of at most ``limit`` characters, the cut marked by the ellipsis."""
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - len(ellipsis)), F.lit(ellipsis)))


def words(text: Column) -> Column:
    """White-space separated words; empty array for blank text."""
    return F.filter(F.split(text, rf"(?U)[{SPACE}]+"), lambda w: w != "")


def collapse_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{SPACE_RE2}]+', ' ', 'g'))"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE_RE2}]+|[{SPACE_RE2}]+$', '', 'g')"


def sql_list(values) -> str:
    """A list of strings as an SQL list literal."""
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def pick(values, key: Column) -> Column:
    """The entry of a constant list that a key selects by remainder."""
    return F.element_at(lit_array(values), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def pick_sql(values, key: str) -> str:
    return f"{sql_list(values)}[CAST(({key}) % {len(values)} AS INTEGER) + 1]"
