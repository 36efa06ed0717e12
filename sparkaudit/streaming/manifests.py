"""Run manifests as a stream of action rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkaudit.sources.lattices import MANIFEST, explode_actions
from sparkaudit.streaming.folders import exists

DAY = 24 * 3600
FIELDS = [c.split()[0] for c in MANIFEST.split(", ")[:5]] + ["actions"]


def landed_manifests(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    return spark.readStream.schema(MANIFEST).option("multiLine", one_per_file).json(path)


def stream_manifests(spark: SparkSession, path: str, watermark: str = "1 day") -> DataFrame:
    """New manifest files to action rows, each run once however often its file lands.

    What comes later than the watermark is dropped; ``start_manifests`` keeps it in a table of its own.
    """
    once = (
        landed_manifests(spark, path)
        .withColumn("ts", F.timestamp_seconds("timestamp"))
        .withWatermark("ts", watermark)
        .dropDuplicatesWithinWatermark(["timestamp"])
    )
    return explode_actions(once)


def start_manifests(manifests: DataFrame, store: str, checkpoint: str, lateness: int = DAY, **trigger) -> StreamingQuery:
    """Store every manifest once: in time, or in the dead-letter table if later than the newest before it by over ``lateness`` seconds.

    A manifest is known by its timestamp; of several with one timestamp in a batch the one of least seed and
    fingerprint is stored, and one whose timestamp is in either table already is a copy.  Both tables are
    partitions of one write below ``store``, by day, so a batch that is run again replaces all that it
    wrote, and only the days that a batch names are searched for copies.  How far earlier
    batches had come is one row for each batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        own = (F.col("stream") == stream) & (F.col("batch") == batch_id)
        place = f"stream={stream}/batch={batch_id}"
        rest = F.struct("seed", "matrix_fp", *[c for c in FIELDS if c not in ("timestamp", "seed", "matrix_fp")])
        once = batch.filter("timestamp IS NOT NULL").groupBy("timestamp").agg(F.min(rest).alias("_r"))
        once = once.select("timestamp", "_r.*").select(*FIELDS)
        once = once.withColumn("run_date", F.to_date(F.timestamp_seconds("timestamp"))).persist()
        try:
            newest = once.agg(F.max("timestamp")).first()[0]
            before = None
            if exists(spark, f"{store}/marks"):
                before = spark.read.parquet(f"{store}/marks").filter(~own).agg(F.max("newest")).first()[0]
                days = [r[0] for r in once.select("run_date").distinct().collect()]
                known = read_store(spark, store).filter(~own & F.col("run_date").isin(days)).select("timestamp")
                fresh = once.join(known, "timestamp", "left_anti")
            else:
                fresh = once
            late = F.lit(False) if before is None else F.col("timestamp") < before - lateness
            # A day's rows are brought together, so that a batch adds one file to it.
            fresh.withColumn("late", late).repartition("run_date").write.mode("overwrite").partitionBy("late", "run_date").parquet(f"{store}/manifests/{place}")
            marks = [x for x in (newest, before) if x is not None]
            spark.createDataFrame([(max(marks, default=None),)], "newest bigint").coalesce(1).write.mode("overwrite").parquet(
                f"{store}/marks/{place}"
            )
        finally:
            once.unpersist()

    writer = manifests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_store(spark: SparkSession, store: str) -> DataFrame:
    schema = f"{MANIFEST}, stream string, batch bigint, late boolean, run_date date"
    return spark.read.schema(schema).option("basePath", f"{store}/manifests").parquet(f"{store}/manifests")


def stored_manifests(spark: SparkSession, store: str, late: bool = False) -> DataFrame:
    """Manifests that came in time, or the dead letters."""
    return read_store(spark, store).filter(F.col("late") == late).select(*FIELDS)
