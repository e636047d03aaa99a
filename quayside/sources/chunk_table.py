"""A chunk table whose documents are replaced as one change.

Chunks lie in buckets by a hash of their document. A version is a small list of folders, one a bucket; replacing
documents writes the buckets they are in anew, beside the old files, and then the next version's list. A version
counts once its list is complete, so readers see all of a change or nothing, and a write that fails leaves
the version before it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.session import finished_folders

BUCKETS = 64
LIST = "bucket int, path string"


class ChunkTable:
    def __init__(self, spark: SparkSession, folder: str, schema: str, document: str = "document_id", buckets: int = BUCKETS) -> None:
        self._spark, self._folder, self._schema = spark, folder.rstrip("/"), schema
        self._document, self._buckets = document, buckets

    def version(self) -> int:
        """The newest complete version; 0 before the first."""
        names = finished_folders(self._spark, f"{self._folder}/versions")
        return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=0)

    def _paths(self, version: int) -> dict[int, str]:
        """Folder of each bucket that holds chunks: as many rows as buckets at most."""
        if not version:
            return {}
        rows = self._spark.read.schema(LIST).parquet(f"{self._folder}/versions/version={version}").collect()
        return {r["bucket"]: r["path"] for r in rows}

    def _rows(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self._spark.createDataFrame([], self._schema)
        return self._spark.read.schema(self._schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """All chunks of the newest, or of an earlier, version."""
        return self._rows(sorted(self._paths(self.version() if version is None else version).values()))

    def replace(self, new: DataFrame, documents: DataFrame | None = None) -> int:
        """The next version, in which the chunks of every document in ``new`` (and in ``documents``, which may have none) are the new ones."""
        before = self.version()
        bucket = F.pmod(F.xxhash64(self._document), F.lit(self._buckets)).cast("int")
        touched = new.select(self._document)
        if documents is not None:
            touched = touched.unionByName(documents.select(self._document))
        touched = touched.distinct()
        held = self._paths(before)
        hit = {r["b"] for r in touched.select(bucket.alias("b")).distinct().collect()}  # as many as buckets at most
        kept = self._rows(sorted(path for b, path in held.items() if b in hit)).join(touched, self._document, "left_anti")
        names = kept.columns
        rows = kept.unionByName(new.select(*names)).withColumn("_bucket", bucket)
        # Each bucket is dealt to a few tasks, so that one huge document's bucket is still written by several.
        target = f"{self._folder}/data/{uuid.uuid4().hex}"
        rows.repartition("_bucket", F.pmod(F.xxhash64(*names), F.lit(4))).write.partitionBy("_bucket").parquet(target)
        written = {r["_bucket"] for r in self._spark.read.schema(f"{self._schema}, _bucket int").parquet(target).select("_bucket").distinct().collect()}
        paths = {b: p for b, p in held.items() if b not in hit} | {b: f"{target}/_bucket={b}" for b in written}
        listed = self._spark.createDataFrame(sorted(paths.items()), LIST)
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self._folder}/versions/version={before + 1}")
        return before + 1
