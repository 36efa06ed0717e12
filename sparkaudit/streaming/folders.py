"""Folders of running streams."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from sparkaudit.landing import shared_folder


def work_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "stream")


def finished(query: StreamingQuery) -> None:
    """Wait for a stream that ends by itself; its error is raised here."""
    query.awaitTermination()


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
