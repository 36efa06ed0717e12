"""Reading a chain of pages up to its first break."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contiguous_pages(pages: DataFrame, by: Sequence[str], page: str, ok: str, has_next: str) -> DataFrame:
    """Keep pages 0..k where each page before k was read and names a next one that was read.

    The end of the chain is the first page without a readable successor, found by an
    equi-join of each page with the one after it and a minimum per group; no window,
    so a group of any length spreads over all tasks.
    """
    by = list(by)
    readable = pages.filter(F.col(ok) & (F.col(page) >= 0))
    links = readable.groupBy(*by, page).agg(F.bool_and(has_next).alias("_next"))
    followers = links.select(*by, (F.col(page) - 1).alias(page), F.lit(True).alias("_follows"))
    last = links.join(followers, [*by, page], "left").withColumn(
        "_linked", F.col("_next") & F.coalesce("_follows", F.lit(False))
    )
    ends = (
        last.groupBy(*by)
        .agg(
            F.min(F.when(~F.col("_linked"), F.col(page))).alias("_end"),
            F.min(page).alias("_first"),
        )
        .filter(F.col("_first") == 0)
        .drop("_first")
    )
    return readable.join(ends, by).filter(F.col(page) <= F.col("_end")).drop("_end")
