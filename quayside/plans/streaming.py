"""Streaming jobs (ST1-ST3), run over the tables as streams of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.plans.corpus import chunks_sql, clean_sql
from quayside.plans.registry import query
from quayside.sources.commerce import Commerce, with_views as v
from quayside.sources.tables import SCHEMAS
from quayside.streaming.admission import admit, admit_stream
from quayside.streaming.indexing import DocumentIndex
from quayside.streaming.live import collect_live_latency, collect_live_stats
from quayside.streaming.run import new_folder, run_available, write_batches

LIMIT, WINDOW = 3, 86_400


class Streams:
    """The tables as streams of Parquet files, for the same views as the batch tables."""

    def __init__(self, tables) -> None:
        self.spark, self.folder = tables.spark, tables.folder

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        # A pattern, because a stream reads folders or patterns but no single file.
        return self.spark.readStream.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}[.]parquet")


ADMISSION_SQL = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_id % 50 NOT IN (11, 12)),
  s AS (SELECT event_id, user_id, n, [us] AS kept, true AS accepted, CAST(NULL AS BIGINT) AS retry_after FROM e WHERE n = 1
    UNION ALL SELECT event_id, user_id, n, CASE WHEN len(live) < {LIMIT} THEN list_append(live, us) ELSE live END, len(live) < {LIMIT},
      CASE WHEN len(live) >= {LIMIT} THEN CAST(greatest(1, ceil((live[1] + {WINDOW * 1_000_000} - us) / 1000000)) AS BIGINT) END
    FROM (SELECT e.event_id, e.user_id, e.n, e.us, list_filter(s.kept, lambda k: k > e.us - {WINDOW * 1_000_000}) AS live FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
  SELECT event_id, accepted, retry_after FROM s UNION ALL SELECT event_id, false, NULL FROM events WHERE event_id % 50 IN (11, 12)"""


def hits(events):
    """Some events lack a user, some a time."""
    kind = F.pmod("event_id", F.lit(50))
    return events.select("event_id", F.when(kind != 11, F.col("user_id")).alias("user_id"), F.when(kind != 12, F.col("ts")).alias("ts"))


@query("st01a_sliding_window_admission", ADMISSION_SQL)
def st01a(t):
    return admit(hits(t.events), "user_id", "ts", "event_id", LIMIT, WINDOW)


@query("st01b_admission_stream", ADMISSION_SQL)
def st01b(t):
    folder = new_folder(t.spark, "admission")
    run_available(admit_stream(hits(Streams(t).events), "user_id", "ts", "event_id", LIMIT, WINDOW, evict_idle=False), write_batches(f"{folder}/rows"), folder)
    return t.spark.read.parquet(f"{folder}/rows").drop("batch")


@query("st02_incremental_index",
       f"""WITH {chunks_sql(f"SELECT min(doc_id) AS doc_id, {clean_sql('text')} AS text FROM documents GROUP BY text")},
       n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1)
       SELECT doc_id AS document_id, 'superseded' AS status, 0 AS chunk_count FROM documents WHERE doc_id % 10 = 3 UNION ALL
       SELECT d.doc_id AS document_id, CASE WHEN src.doc_id IS NULL THEN 'refused' WHEN n IS NULL THEN 'failed' ELSE 'indexed' END AS status, CAST(coalesce(n, 0) AS INTEGER) AS chunk_count
       FROM documents d LEFT JOIN src USING (doc_id) LEFT JOIN n USING (doc_id)""")
def st02(t):
    folder = new_folder(t.spark, "index")
    index = DocumentIndex(t.spark, folder)
    files = Streams(t).documents.select(F.col("doc_id").alias("document_id"), "text", F.lit(False).alias("reindex"), F.lit(1).alias("sent"))

    def with_older(batch, batch_id):
        """Some documents come with an older version in the same batch."""
        older = batch.where("document_id % 10 = 3").withColumns({"text": F.concat(F.lit("old "), "text"), "sent": F.lit(0)})
        index.process(batch.unionByName(older), batch_id)

    run_available(files, with_older, folder)
    return index.attempts().select("document_id", "status", "chunk_count")


def live_runs(t):
    return Commerce(Streams(t)).agent_runs().select(
        F.col("created_at").cast("timestamp").alias("created_at"), F.coalesce("route", F.lit("none")).alias("route"), "status", "total_ms")


@query("st03_live_run_stats", v(
    """SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M') AS window_start, coalesce(route, 'none') AS route, status, count(*) AS runs, CAST(sum(total_ms) AS BIGINT) AS total_ms
    FROM v_runs GROUP BY ALL"""))
def st03(t):
    stats = collect_live_stats(live_runs(t), "created_at")
    return stats.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("st03b_live_latency", v(
    """WITH n AS (SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d') AS window_start, coalesce(route, 'none') AS route, total_ms FROM v_runs),
    g AS (SELECT window_start, route, count(*) AS runs, list_sort(list(total_ms) FILTER (WHERE total_ms IS NOT NULL)) AS l FROM n GROUP BY ALL)
    SELECT window_start, route, runs, l[CAST(ceil(0.95 * len(l)) AS INTEGER)] AS latency FROM g"""))
def st03b(t):
    """Windows of fewer runs than the sketch's accuracy, so its percentile is the exact one."""
    stats = collect_live_latency(live_runs(t), "created_at", every="1 day")
    return stats.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))
