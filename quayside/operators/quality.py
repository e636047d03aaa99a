"""Deduplication, chunk replacement, result pages, constraints, and table profiles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def dedup_by_checksum(df: DataFrame, key: str, content: str) -> DataFrame:
    """Each row with its checksum and the key of the first identical row (the keeper).

    The keeper is a map-side minimum per checksum. Only checksums that repeat are joined
    back; a group of copies that fills a third of the table is a skewed left side that
    AQE splits, and rows without copies never leave the anti-duplicate default. (Reading the texts
    once would need one exchange by checksum for both sides, which nothing splits.)"""
    marked = df.select(key, checksum(F.col(content)).alias("checksum"))
    keepers = marked.groupBy("checksum").agg(F.min(key).alias("keeper"), F.count("*").alias("_n"))
    repeated = keepers.filter("_n > 1").drop("_n")
    return marked.join(repeated, "checksum", "left").select(
        key, "checksum", F.coalesce("keeper", key).alias("keeper"),
        (F.coalesce("keeper", key) != F.col(key)).alias("duplicate"))


def result_page(df: DataFrame, max_rows: int, *order: Column) -> DataFrame:
    """At most ``max_rows`` rows and whether more were there; reads one row beyond the cap."""
    page = df.orderBy(*order).limit(max_rows + 1)
    position = F.row_number().over(Window.orderBy(*order))  # over the bounded page only
    fetched = F.count("*").over(Window.partitionBy(F.lit(1)))
    return (
        page.withColumn("_at", position).withColumn("truncated", fetched > max_rows)
        .filter(F.col("_at") <= max_rows).drop("_at")
    )


LONG_DIGITS = 18  # digits that any whole number of 64 bits can hold


def iso_timestamp(column: Column, zoned: bool) -> Column:
    """ISO form; a time with zone ends with its offset in the session's zone."""
    micros = F.date_format(column, "SSSSSS")
    return F.concat(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""),
                    F.date_format(column, "xxx") if zoned else F.lit(""))


def json_safe(df: DataFrame) -> DataFrame:
    """Columns as JSON scalars: floats to 6 digits, whole decimals to integers, ISO times.

    Whole decimals that 64 bits may not hold stay decimals."""

    def convert(field: T.StructField) -> Column:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            column = F.round(column, 6)
        elif isinstance(kind, T.DecimalType):
            if kind.scale > 0:
                column = column.cast("double")
            elif kind.precision <= LONG_DIGITS:
                column = column.cast("bigint")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = iso_timestamp(column, isinstance(kind, T.TimestampType))
        elif isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, T.BinaryType):
            column = F.when(column.isNotNull(), "<binary>")
        elif not isinstance(kind, (T.BooleanType, T.IntegralType, T.StringType)):
            column = column.cast("string")
        return column.alias(field.name)

    return df.select(*[convert(field) for field in df.schema.fields])


def to_json_rows(df: DataFrame) -> DataFrame:
    return json_safe(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))


# --- declarative constraints ------------------------------------------------------------


@dataclass(frozen=True)
class Unique:
    name: str
    table: DataFrame
    columns: tuple[str, ...]

    def violations(self) -> DataFrame:
        groups = self.table.groupBy(*self.columns).agg(F.count("*").alias("_n"))
        return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations"))


@dataclass(frozen=True)
class References:
    """Rows whose key has no partner (a null key passes). Keys are counted before the exchange, so a hot key is a row a task."""

    name: str
    child: DataFrame
    column: str
    parent: DataFrame
    parent_column: str


@dataclass(frozen=True)
class Check:
    """Rows where the condition is false (null passes, as in SQL)."""

    name: str
    table: DataFrame
    condition: Column


def _by_table(constraints: list, table: str) -> list[list]:
    groups: dict[int, list] = {}
    for c in constraints:
        groups.setdefault(getattr(c, table).semanticHash(), []).append(c)
    return list(groups.values())


def _named(pairs: list[tuple[str | int, Column]]) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(n).alias("constraint"), v.alias("value")) for n, v in pairs]))


def check_constraints(constraints: list[Unique | References | Check]) -> DataFrame:
    """One row per constraint with its number of violating rows.

    All checks of a table are one aggregation over one scan. All foreign keys are one aggregation too, with one scan of
    a child for its keys: a key's rows are counted beside whether a parent holds it, so nothing is joined. Keys are
    compared as whole numbers if all of them are, otherwise as text."""
    kinds = {k: [c for c in constraints if isinstance(c, k)] for k in (Unique, References, Check)}
    counted = [c.violations().select(F.lit(c.name).alias("constraint"), "violations") for c in kinds[Unique]]
    for checks in _by_table(kinds[Check], "table"):
        row = checks[0].table.agg(*[F.count_if(~c.condition).alias(f"n{i}") for i, c in enumerate(checks)])
        counted.append(row.select(_named([(c.name, F.col(f"n{i}")) for i, c in enumerate(checks)])).withColumnRenamed("value", "violations"))
    if refs := kinds[References]:
        kind = "bigint" if all(isinstance(t.schema[c].dataType, T.IntegralType) for r in refs for t, c in ((r.child, r.column), (r.parent, r.parent_column))) else "string"
        number = {r.name: i for i, r in enumerate(refs)}
        children = [cs[0].child.select(_named([(number[c.name], F.col(c.column).cast(kind)) for c in cs])).withColumn("n", F.lit(1)) for cs in _by_table(refs, "child")]
        parents = [r.parent.select(F.lit(i).alias("constraint"), F.col(r.parent_column).cast(kind).alias("value"), F.lit(0).alias("n")) for i, r in enumerate(refs)]
        keys = reduce(DataFrame.unionByName, children + parents).where("value is not null").groupBy("constraint", "value")
        orphans = keys.agg(F.sum("n").alias("violations"), F.min("n").alias("least")).where("least = 1").select("constraint", "violations")
        none = refs[0].child.sparkSession.range(1).select(_named([(i, F.lit(0).cast("bigint")) for i in range(len(refs))])).withColumnRenamed("value", "violations")  # every constraint has a result
        per_ref = orphans.unionByName(none).groupBy("constraint").agg(F.sum("violations").alias("violations"))
        counted.append(per_ref.select(F.element_at(F.array(*[F.lit(r.name) for r in refs]), F.col("constraint") + 1).alias("constraint"), "violations"))
    return reduce(DataFrame.unionByName, counted)


# --- table profiles ------------------------------------------------------------------------


def profile_table(name: str, df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per column: type, key flag, description, rows, nulls - one pass, one row shuffled."""
    fields = df.schema.fields
    nulls = [F.count_if(F.col(f.name).isNull()).alias(f"n{i}") for i, f in enumerate(fields)]
    counts = df.agg(F.count("*").alias("row_count"), *nulls)
    entries = F.array(*[
        F.struct(
            F.lit(i + 1).alias("position"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.name in keys).alias("is_key"),
            F.lit((f.metadata or {}).get("comment")).cast("string").alias("description"),
            F.col(f"n{i}").alias("null_count"))
        for i, f in enumerate(fields)
    ])
    return counts.select(F.lit(name).alias("table"), "row_count", F.lit(len(fields)).alias("column_count"),
                         F.explode(entries).alias("e")).select("table", "row_count", "column_count", "e.*")


def profile_tables(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [profile_table(n, df, keys.get(n, ())) for n, df in tables.items()])
