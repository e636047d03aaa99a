"""The physical tables: Parquet folders read with a declared schema.

Declaring the schema avoids a footer-reading job per table and lets Spark prune
columns and push filters from the first plan on."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from quayside.session import spread

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Columns that tell the rows of a table apart (line items have none).
ROW_KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",),
    "part": ("p_partkey",), "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",),
    "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",), "labels": ("doc_id",),
    "conversations": ("conv_id", "turn"),
}


class Tables:
    """Lazy access to the tables under one folder: ``Tables(spark, dir).orders``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table for CPU-heavy work: few small files are spread over the cores by row key,
        so that a hot conversation does not become a hot partition."""
        return spread(getattr(self, name), *ROW_KEYS[name])

    @cached_property
    def commerce(self):
        from quayside.sources.commerce import Commerce

        return Commerce(self)
