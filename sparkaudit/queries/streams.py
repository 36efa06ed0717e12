"""Streams run over the driver tables to their end, each with the SQL that its batch form must agree with."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from sparkaudit.operators.transcripts import utterances
from sparkaudit.queries import table
from sparkaudit.queries.audit import MEDIA_AUDIT_SQL, order_probes
from sparkaudit.sinks.lattices import write_manifests
from sparkaudit.sources.lattices import explode_actions, read_run_manifests
from sparkaudit.streaming.folders import finished, work_folder
from sparkaudit.streaming.graded import graded_ranges, start_graded_audit
from sparkaudit.streaming.manifests import DAY, landed_manifests, start_manifests, stored_manifests
from sparkaudit.streaming.utterances import start_utterances, wait_for_fragments

GAP_HOURS, PER_PART = 12, 5
PIECES = 3
#: Years of orders are weeks of manifests here, so that a day has many.
SLOWER = 50
LATENESS = 20 * DAY


def said(events):
    return events.select(F.col("user_id").alias("call_id"), "ts", F.col("event_type").alias("text"))


def batch_utterances(spark, d):
    return utterances(said(table(spark, d, "events")), GAP_HOURS * 3600.0, PER_PART)


def live_utterances(spark, d):
    """The same rows out of a stream: calls close by their timers."""
    events = table(spark, d, "events")
    folder = work_folder(spark)
    # A pattern, as the table may be one file and a stream's plain path must be a folder.
    stream = said(spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*"))
    query = start_utterances(
        stream, f"{folder}/out", f"{folder}/checkpoint", "0 seconds", gap=timedelta(hours=GAP_HOURS), idle=timedelta(seconds=1), per_part=PER_PART
    )
    wait_for_fragments(spark, query, f"{folder}/out", events.filter("ts IS NOT NULL").count())
    return spark.read.parquet(f"{folder}/out").drop("late")


UTTERANCES_SQL = f"""
  WITH a AS (SELECT user_id AS call_id, ts, event_type AS text, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS b FROM events),
  s AS (SELECT *, sum(CASE WHEN b IS NULL OR epoch_us(ts) - epoch_us(b) >= {GAP_HOURS * 3600} * 1000000::BIGINT THEN 1 ELSE 0 END)
                  OVER (PARTITION BY call_id ORDER BY ts, text ROWS UNBOUNDED PRECEDING) AS session FROM a),
  r AS (SELECT *, row_number() OVER (PARTITION BY call_id, session ORDER BY ts, text) AS k,
               count(*) OVER (PARTITION BY call_id, session) AS n, min(ts) OVER (PARTITION BY call_id, session) AS start FROM s)
  SELECT call_id, start, max(ts) AS "end", ((k - 1) // {PER_PART})::INT AS part, count(*)::INT AS fragments,
         string_agg(text, ' ' ORDER BY k) AS text, max(k) = max(n) AS final
  FROM r GROUP BY call_id, session, start, (k - 1) // {PER_PART}
"""


def order_manifests(spark, d):
    """A manifest for each order; its line items are the actions.  Some orders share a timestamp."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.lpad(F.col("l_linenumber").cast("string"), 2, "0").alias("file"), F.col("l_returnflag").alias("transform"),
                    F.col("l_partkey").cast("string").alias("message"),
                )
            )
        ).alias("actions")
    )
    orders = table(spark, d, "orders").withColumn("l_orderkey", F.col("o_orderkey"))
    none = F.array().cast("array<struct<file:string,transform:string,message:string>>")
    return orders.join(items, "l_orderkey", "left").select(
        (F.expr(f"unix_seconds(CAST(o_orderdate AS TIMESTAMP)) DIV {SLOWER}") + F.col("o_custkey") % 500).alias("timestamp"), F.col("o_orderkey").alias("seed"),
        F.col("o_orderstatus").alias("matrix_fp"), F.col("o_totalprice").alias("entropy"), F.lit(0.0).alias("depth"),
        F.coalesce("actions", none).alias("actions"),
    )


def manifest_files(spark, d):
    """Manifests written as files, read back, one row per action."""
    folder = work_folder(spark)
    write_manifests(order_manifests(spark, d), folder)
    return explode_actions(read_run_manifests(spark, folder, one_per_file=False)).select(
        "timestamp", "seed", "matrix_fp", "entropy", "action_no", "file", "transform", "message"
    )


MANIFESTS_SQL = f"""
  SELECT (epoch_us(o_orderdate) // 1000000 // {SLOWER} + o_custkey % 500)::BIGINT AS timestamp, o_orderkey AS seed, o_orderstatus AS matrix_fp,
         o_totalprice AS entropy"""
MANIFEST_FILES_SQL = f"""
  SELECT m.*, CASE WHEN l.l_orderkey IS NOT NULL
                   THEN (row_number() OVER (PARTITION BY m.seed ORDER BY l.l_linenumber, l.l_returnflag, l.l_partkey::VARCHAR) - 1)::INT END AS action_no,
         lpad(l.l_linenumber::VARCHAR, 2, '0') AS file, l.l_returnflag AS transform, l.l_partkey::VARCHAR AS message
  FROM ({MANIFESTS_SQL} FROM orders) m LEFT JOIN lineitem l ON l.l_orderkey = m.seed
"""


def manifest_stream(spark, d):
    """Manifests that land in three pieces, each a batch: those in time and the dead letters."""
    folder = work_folder(spark)
    manifests = order_manifests(spark, d)
    for piece in range(PIECES):
        write_manifests(manifests.filter(F.col("seed") % PIECES == piece), f"{folder}/landing")
        landing = landed_manifests(spark, f"{folder}/landing", one_per_file=False)
        finished(start_manifests(landing, f"{folder}/store", f"{folder}/checkpoint", LATENESS))
    tables = [stored_manifests(spark, f"{folder}/store", late).withColumn("late", F.lit(late)) for late in (False, True)]
    return tables[0].unionByName(tables[1]).select("timestamp", "seed", "matrix_fp", "entropy", F.size("actions").alias("actions"), "late")


MANIFEST_STREAM_SQL = f"""
  WITH m AS (SELECT *, seed % {PIECES} AS piece FROM ({MANIFESTS_SQL} FROM orders)),
  k AS (SELECT *, row_number() OVER (PARTITION BY timestamp ORDER BY piece, seed) AS copy FROM m),
  b AS (SELECT piece, max(max(timestamp)) OVER (ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m GROUP BY piece)
  SELECT timestamp, seed, matrix_fp, entropy, (SELECT count(*) FROM lineitem WHERE l_orderkey = seed)::INT AS actions,
         coalesce(timestamp < before - {LATENESS}, false) AS late
  FROM k JOIN b USING (piece) WHERE copy = 1
"""


def audit_stream(spark, d):
    """Probe payloads that arrive in three batches; grades by the order index of the store."""
    folder = work_folder(spark)
    probes = order_probes(spark, d).withColumn("_piece", F.pmod(F.xxhash64("path"), F.lit(PIECES)))
    for piece in range(PIECES):
        part = probes.filter(F.col("_piece") == piece).drop("_piece")
        part.write.mode("append").parquet(f"{folder}/landing")
        stream = spark.readStream.schema(part.schema).parquet(f"{folder}/landing")
        finished(start_graded_audit(stream, f"{folder}/store", f"{folder}/checkpoint"))
    return graded_ranges(spark, f"{folder}/store").select(
        "path", "size_bytes", "codec", "corrupt", "corrupt_reason", "percentile", "grade",
        F.round("norm_efficiency", 9).alias("norm_efficiency"),
    )


QUERIES = {
    "q_utterances": (batch_utterances, UTTERANCES_SQL),
    "q_live_utterances": (live_utterances, UTTERANCES_SQL),
    "q_manifest_files": (manifest_files, MANIFEST_FILES_SQL),
    "q_manifest_stream": (manifest_stream, MANIFEST_STREAM_SQL),
    "q_audit_stream": (audit_stream, f"SELECT * FROM ({MEDIA_AUDIT_SQL}) WHERE NOT corrupt"),
}
