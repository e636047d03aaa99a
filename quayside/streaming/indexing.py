"""Incremental indexing of a document stream.

Every micro-batch refuses files that are already in the index (or earlier in the batch),
cuts the others into chunks and adds them under the batch's own folders, so a repeated
batch replaces itself and lost executors only cost a retry. A re-indexed document gets a
newer version; readers take the newest version of each document. Texts are written once, where they were read;
ids and checksums alone are exchanged, and what a batch staged is removed when its results are there."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.cleaning import clean_text
from quayside.functions.injection import injection_markers
from quayside.operators.chunking import CHUNK_SIZE, OVERLAP, chunk_array, single_page, token_estimate
from quayside.operators.corpus import NO_READABLE_TEXT
from quayside.operators.quality import checksum
from quayside.session import remove_folder, spread

NO_ID = "This document has no id."
SUPERSEDED = "A later version of this document came in the same batch."
DOCUMENTS = "document_id bigint, checksum string, status string, error string, chunk_count int, batch bigint"
CHUNKS = (
    "document_id bigint, chunk_index int, content string, page int, section string, token_estimate int, "
    "suspicious boolean, batch bigint"
)


class DocumentIndex:
    def __init__(self, spark: SparkSession, folder: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> None:
        self._spark, self._folder, self._size, self._overlap = spark, folder, size, overlap

    def _stored(self, name: str, schema: str) -> DataFrame:
        """Rows of all finished batches; empty before the first."""
        try:
            return self._spark.read.schema(schema).parquet(f"{self._folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # anything but a folder that does not exist yet
                raise
            return self._spark.createDataFrame([], schema)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Index (document_id, text, reindex[, sent]) rows; usable as a foreachBatch sink.

        Of several versions of a document in a batch the last by ``sent`` counts (of equal ones that of the
        largest checksum), the others are recorded as superseded. Equal texts of a document are one version, sent
        when the last of them was, and re-indexed if any of them asks for it. Null texts and rows without an id
        are recorded as failed."""
        staged = f"{self._folder}/staged/batch={batch_id}"
        sent = F.col("sent") if "sent" in batch.columns else F.lit(0)
        texts = spread(batch, "document_id").select("document_id", "text", "reindex", sent.alias("sent"), checksum(F.col("text")).alias("checksum"))
        texts = self._staged(texts, f"{staged}/texts").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
        verdicts = self._staged(self._verdicts(texts, batch_id), f"{staged}/verdicts")
        # Verdicts are stored, so their size is known when the join is planned: texts stay where they are and each is
        # met by its row's verdict. Only beyond the broadcast limit would Spark deal both sides out.
        chosen = texts.select("place", "text").join(verdicts.where("status is null"), "place")
        chunks = F.when(~F.col("refused"), chunk_array(single_page(clean_text(F.col("text"))), self._size, self._overlap))
        # Both outputs are written from one table, so the chunks are made once; their number spares the first one reading them.
        work = chosen.select("document_id", "checksum", "refused", chunks.alias("chunks")).select("*", F.size("chunks").alias("n"))
        work = self._staged(work, f"{staged}/work")
        found = F.coalesce(F.col("n") > 0, F.lit(False))
        judged = work.select(
            "document_id", "checksum",
            F.when(F.col("refused"), "refused").when(found, "indexed").otherwise("failed").alias("status"),
            F.when(F.col("refused"), "This file is already in the knowledge base.").when(~found, NO_READABLE_TEXT).alias("error"),
            F.when(F.col("refused"), 0).when(found, F.col("n")).otherwise(0).alias("chunk_count"),
        )
        others = verdicts.where("status is not null").select("document_id", "checksum", "status", "error", F.lit(0).alias("chunk_count"))
        judged.unionByName(others).write.mode("overwrite").parquet(f"{self._folder}/documents/batch={batch_id}")
        work.filter(~F.col("refused")).select("document_id", F.posexplode("chunks").alias("chunk_index", "c")).select(
            "document_id", "chunk_index", "c.content", "c.page", "c.section", token_estimate(F.col("c.content")).alias("token_estimate"),
            (F.size(injection_markers(F.col("c.content"))) > 0).alias("suspicious"),
        ).write.mode("overwrite").parquet(f"{self._folder}/chunks/batch={batch_id}")
        remove_folder(self._spark, staged)

    def _staged(self, rows: DataFrame, path: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(path)
        return self._spark.read.schema(rows.schema).parquet(path)

    def _verdicts(self, texts: DataFrame, batch_id: int) -> DataFrame:
        """What becomes of each version: ``document_id, checksum, status, error, refused, place``.

        Status is null for those whose text, that of the row at ``place``, is to be looked at. Works on ids and checksums only."""
        rows = texts.groupBy("document_id", "checksum").agg(F.max("reindex").alias("reindex"), F.max("sent").alias("sent"), F.min("place").alias("place"))
        named = rows.filter("document_id is not null")
        last = named.groupBy("document_id").agg(F.max_by("checksum", F.struct("sent", "checksum")).alias("checksum"))
        newest = last.select(F.col("document_id").alias("_id"), F.col("checksum").alias("_checksum"))
        is_last = (F.col("document_id") == F.col("_id")) & F.col("checksum").eqNullSafe(F.col("_checksum"))
        files = named.join(newest, is_last, "left_semi")
        older = named.join(newest, is_last, "left_anti")
        # The batch is the small side: the stored checksums are only scanned.
        stored = self._stored("documents", DOCUMENTS).filter(F.col("batch") != batch_id)
        known = stored.filter("status not in ('refused', 'superseded')").select("checksum", F.col("document_id").alias("owner"))
        known = known.join(files.select("checksum"), "checksum", "left_semi").groupBy("checksum").agg(F.min("owner").alias("owner"))
        first = files.groupBy("checksum").agg(F.min("document_id").alias("first")).where("checksum is not null")
        owners = first.join(known, "checksum", "left").select("checksum", F.coalesce("owner", "first").alias("owner"),
                                                              F.col("owner").isNotNull().alias("stored"))
        refused = ~F.col("reindex") & ((F.col("owner") != F.col("document_id")) | F.col("stored"))
        # A null text has no owner: nothing is like it.
        looked_at = files.join(owners, "checksum", "left").select(
            "document_id", "checksum", F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("error"),
            F.coalesce(refused, F.lit(False)).alias("refused"), "place")

        def settled(df: DataFrame, status: str, error: str) -> DataFrame:
            return df.select("document_id", "checksum", F.lit(status).alias("status"), F.lit(error).alias("error"), F.lit(False).alias("refused"), "place")

        nameless = settled(rows.filter("document_id is null"), "failed", NO_ID)
        return looked_at.unionByName(settled(older, "superseded", SUPERSEDED)).unionByName(nameless)

    def attempts(self) -> DataFrame:
        """Every document ever sent, with the outcome of its batch."""
        return self._stored("documents", DOCUMENTS)

    def documents(self) -> DataFrame:
        """The newest accepted version of each document."""
        accepted = self.attempts().filter("status not in ('refused', 'superseded')")
        newest = accepted.groupBy("document_id").agg(F.max("batch").alias("batch"))
        return accepted.join(newest, ["document_id", "batch"])

    def chunks(self) -> DataFrame:
        """Chunks of the newest version of each document."""
        current = self.documents().select("document_id", "batch")
        return self._stored("chunks", CHUNKS).join(current, ["document_id", "batch"], "left_semi")
