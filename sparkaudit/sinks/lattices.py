"""Lattice sinks: matrix text and run manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.operators.lattice import row_texts


def write_lattices(cells: DataFrame, path: str, by: str = "lattice_id") -> None:
    """Space-joined rows in row order, one directory per lattice."""
    rows = row_texts(cells, by).withColumnRenamed("text", "value")
    ordered = rows.repartitionByRange(by, "r").sortWithinPartitions(by, "r")
    ordered.drop("r").write.mode("overwrite").partitionBy(by).text(path)


def manifests_by_day(manifests: DataFrame) -> DataFrame:
    day = F.to_date(F.timestamp_seconds("timestamp"))
    return manifests.withColumn("run_date", day)


def write_manifests(manifests: DataFrame, path: str) -> None:
    """A folder for each day, one manifest a line."""
    manifests_by_day(manifests).write.mode("append").partitionBy("run_date").json(path)
