"""Snapshots of foreign tables: read over JDBC, keep as Parquet or as a bucketed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(spark: SparkSession, url: str, table: str, *, column: str, lower: int, upper: int, partitions: int,
              **options: str) -> DataFrame:
    """A database table, fetched in parallel slices of a numeric column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions).load()


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a Parquet snapshot; partition columns let later filters skip files.

    Rows are not gathered per partition value first, so a value that fills a third of the
    table is still written by many tasks."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, folder: str) -> DataFrame:
    """Keep a snapshot as a table bucketed by its join key, so that joins on it need no shuffle; read it back.

    Rows are dealt by the key once, so each bucket is one file."""
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", folder).saveAsTable(table)
    return df.sparkSession.table(table)
