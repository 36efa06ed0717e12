"""Registered queries of the training-data operators: name to (query, SQL it must agree with, or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from sparkaudit.llm import queries

Query = Callable[[SparkSession, str], DataFrame]


def llm_registry() -> dict[str, tuple[Query, str | None]]:
    return {**queries.QUERIES, "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)}
