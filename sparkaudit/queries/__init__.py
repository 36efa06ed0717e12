"""Registered queries: each module maps a name to (query function, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> dict[str, tuple[Query, str | None]]:
    from sparkaudit.queries import audit, lattice, points, reconcile, streams, timeline

    found: dict[str, tuple[Query, str | None]] = {}
    for module in (audit, reconcile, lattice, timeline, points, streams):
        found.update(module.QUERIES)
    return found
