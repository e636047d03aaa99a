"""From cleaned documents to an indexable chunk table and its roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.injection import injection_markers
from quayside.functions.text import BENGALI, strip
from quayside.operators.chunking import CHUNK_SIZE, OVERLAP, chunk_array, token_estimate

DIMENSIONS = 384
# What a feature token is, and the weight that keeps vectors from being zero.
TOKEN = rf"[0-9a-z{BENGALI}]+"
LAST_BUCKET_WEIGHT = 0.01
NO_READABLE_TEXT = "The document does not contain any readable text."


def embedding_text(title: Column, section: Column, content: Column) -> Column:
    return strip(F.concat(title, F.lit("\n"), F.coalesce(section, F.lit("")), F.lit("\n"), content))


def feature_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def bucket_of_token(token: Column, dim: int = DIMENSIONS) -> Column:
    """md5 as a 128-bit number modulo the dimension, eight hex digits at a time."""
    digest = F.md5(token)
    rest = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        part = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        rest = (rest * F.lit(2**32) + part) % dim
    return rest.cast("int")


def hash_features(df: DataFrame, key: str, text: Column, dim: int = DIMENSIONS) -> DataFrame:
    """Sparse bag-of-words vectors: (key, bucket, weight); the last bucket is never zero.

    All tokens of a text are in its row, so they are counted there: nothing is shuffled and the text is
    read once. Buckets and counts are two passes over the row's sorted buckets."""
    buckets = F.transform(feature_tokens(text), lambda token: bucket_of_token(token, dim))
    rows = df.select(key, F.array_sort(F.coalesce(buckets, F.array().cast("array<int>"))).alias("_buckets"))
    n = F.size("_buckets")
    # The last place of each run of equal buckets; a run's length is its distance from the one before.
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get("_buckets", i) != F.get("_buckets", i - 1)))
    rows = rows.select(key, "_buckets", F.when(n > 0, ends).otherwise(F.array().cast("array<int>")).alias("_ends"))
    counted = F.transform("_ends", lambda end, i: F.struct(
        F.get("_buckets", end - 1).alias("bucket"),
        (end - F.when(i > 0, F.get("_ends", i - 1)).otherwise(0)).cast("double").alias("weight")))
    last = dim - 1
    plus = F.transform(counted, lambda x: F.struct(x["bucket"].alias("bucket"), F.round(x["weight"] + F.when(x["bucket"] == last, LAST_BUCKET_WEIGHT).otherwise(0.0), 6).alias("weight")))
    alone = F.array(F.struct(F.lit(last).alias("bucket"), F.lit(LAST_BUCKET_WEIGHT).alias("weight")))
    whole = F.when(F.array_contains("_buckets", last), plus).otherwise(F.concat(plus, alone))
    return rows.select(key, F.inline(whole))


def build_chunks(documents: DataFrame, key: str, pages: Column, *, title: Column, size: int = CHUNK_SIZE,
                 overlap: int = OVERLAP, markdown: bool = False) -> DataFrame:
    """The chunk table: content, place, token estimate, suspicious-text flag, text to embed."""
    chunks = documents.select(
        key, title.alias("title"),
        F.posexplode(chunk_array(pages, size, overlap, markdown, title)).alias("chunk_index", "c"))
    markers = injection_markers(F.col("c.content"))
    return chunks.select(
        key, "title", "chunk_index", "c.content", "c.page", "c.section",
        token_estimate(F.col("c.content")).alias("token_estimate"),
        embedding_text(F.col("title"), F.col("c.section"), F.col("c.content")).alias("embedding_text"),
        markers.alias("injection_markers"),
    ).withColumn("suspicious", F.size("injection_markers") > 0)


def document_rollup(documents: DataFrame, key: str, pages: Column, page_count: Column, indexed_at: Column,
                    *, title: Column | None = None, size: int = CHUNK_SIZE, overlap: int = OVERLAP,
                    markdown: bool = False) -> DataFrame:
    """Indexing result per document; a document without chunks has failed.

    Counts are taken from the chunk array of the row, so nothing is grouped or joined."""
    rows = documents.select(key, chunk_array(pages, size, overlap, markdown, title).alias("chunks"),
                            page_count.alias("_pages"), indexed_at.alias("_at"))
    content = F.transform("chunks", lambda c: c["content"])
    ok = F.size("chunks") > 0
    characters = F.aggregate(content, F.lit(0), lambda acc, c: acc + F.length(c))
    suspicious = F.size(F.filter(content, lambda c: F.size(injection_markers(c)) > 0))
    return rows.select(
        key,
        F.when(ok, "indexed").otherwise("failed").alias("status"),
        F.when(~ok, NO_READABLE_TEXT).alias("error"),
        F.size("chunks").alias("chunk_count"),
        F.when(ok, F.col("_pages")).alias("page_count"),
        F.when(ok, characters).alias("characters"),
        F.when(ok, suspicious).alias("suspicious_chunks"),
        F.when(ok, F.col("_at")).alias("indexed_at"))


def list_documents(documents: DataFrame, *newest: Column) -> DataFrame:
    return documents.orderBy(*newest)


def indexed_titles(documents: DataFrame) -> DataFrame:
    return documents.filter("status = 'indexed'").select("title").orderBy("title")


def chunk_page(chunks: DataFrame, key: str, document_id, limit: int, offset: int) -> DataFrame:
    """One page of a document's chunks with the number of all its chunks."""
    mine = chunks.filter(F.col(key) == document_id)
    total = mine.agg(F.count("*")).scalar()
    return mine.orderBy("chunk_index").offset(offset).limit(limit).withColumn("total", total)
