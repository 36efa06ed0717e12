"""Text lines of many files with their place inside each file, without one task per file."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value): file splits in byte order, lines in order inside a split.

    A split never exceeds ``spark.sql.files.maxPartitionBytes``, so windows over
    (file, block) stay small however large a file is.
    """
    lines = spark.read.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )


def offsets_in_file(lines: DataFrame, amounts: Mapping[str, Column]) -> DataFrame:
    """Add, per name, the sum of its amount over all earlier lines of the same file.

    Summed inside each split, then over the splits of a file (one row per split).
    """
    within = W.partitionBy("file", "block").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    splits = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)

    def before(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    counted = lines.withColumns({f"_n_{name}": amount for name, amount in amounts.items()})
    bases = (
        counted.groupBy("file", "block")
        .agg(*[F.sum(f"_n_{name}").alias(f"_n_{name}") for name in amounts])
        .select("file", "block", *[before(f"_n_{name}", splits).alias(f"_base_{name}") for name in amounts])
    )
    placed = counted.withColumns({f"_in_{name}": before(f"_n_{name}", within) for name in amounts})
    joined = placed.join(bases, ["file", "block"])
    return joined.select(
        *lines.columns, *[(F.col(f"_base_{name}") + F.col(f"_in_{name}")).alias(name) for name in amounts]
    )
