"""Continuous media audit: probe payloads stream in, verdicts are stored, grades are taken from the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkaudit.operators import audit as A
from sparkaudit.sources.media import read_probe_payloads


def judged_stream(payloads: DataFrame) -> DataFrame:
    """Verdict and scores of each payload; stateless, so it runs on a stream or a table."""
    return A.with_verdict(read_probe_payloads(payloads))


def start_audit(payloads: DataFrame, store: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write each batch of verdicts under its own directory of ``store``.

    A batch that is run again replaces its own directory, so every payload is stored once.  The
    directory also names the stream, whose batches count anew with a new checkpoint.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        stamped = batch.withColumn("_stored", F.current_timestamp())
        stamped.write.mode("overwrite").parquet(f"{store}/stream={stream}/batch={batch_id}")

    writer = judged_stream(payloads).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stored_files(spark: SparkSession, store: str) -> DataFrame:
    """Latest verdict per path."""
    stored = spark.read.option("basePath", store).parquet(store)
    fields = [c for c in stored.columns if c not in ("path", "batch", "stream", "_stored")]
    latest = F.max_by(F.struct(*fields), F.struct("_stored", F.col("batch").cast("bigint"), *[F.col(c) for c in fields]))
    return stored.groupBy("path").agg(latest.alias("_f")).select("path", "_f.*")


def graded_store(spark: SparkSession, store: str) -> DataFrame:
    good = stored_files(spark, store).filter(~F.col("corrupt"))
    return A.percentile_grade(good)
