"""Seeded draws.  Every draw is a hash of the seed and the row key, so it survives re-runs and re-partitioning."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkaudit.functions.numeric import draw_integer, draw_unit
from sparkaudit.operators.ordering import ranked
from sparkaudit.sources.lattices import synthetic_token

#: Draws are below this; a threshold stands so many standard deviations above what it must let through.
DRAWS, MARGIN = 1 << 60, 6


def draw_from_pool(df: DataFrame, seed: int, key: Sequence[str], pool: DataFrame, name: str = "token") -> DataFrame:
    """Add one pool token per row, drawn with replacement: an equi-join on the drawn index."""
    size = pool.agg(F.count(F.lit(1))).scalar()
    drawn = df.withColumn("pool_index", draw_integer(seed, *[F.col(k) for k in key]) % size)
    return drawn.join(pool.withColumnRenamed("token", name), "pool_index").drop("pool_index")


def generate_lattices(
    spark: SparkSession,
    count: int,
    rows: int = 16,
    cols: int = 16,
    seed: int = 0,
    pool: DataFrame | None = None,
    pool_size: int = 2048,
) -> DataFrame:
    """Lattices of drawn tokens; without a pool the synthetic tokens are computed, not joined."""
    frame = spark.range(count).withColumnRenamed("id", "lattice_id")
    return generate_for(frame, rows, cols, seed, pool, pool_size)


def generate_for(
    lattices: DataFrame, rows: int = 16, cols: int = 16, seed: int = 0, pool: DataFrame | None = None, pool_size: int = 2048
) -> DataFrame:
    """The same for the lattices of a table with ``lattice_id``."""
    place = F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1)))
    cells = lattices.select("lattice_id", place.alias("_i"))
    frame = cells.select("lattice_id", F.floor(F.col("_i") / cols).cast("int").alias("r"), (F.col("_i") % cols).alias("c"))
    if pool is not None:
        return draw_from_pool(frame, seed, ["lattice_id", "r", "c"], pool)
    index = draw_integer(seed, F.col("lattice_id"), F.col("r"), F.col("c")) % pool_size
    return frame.withColumn("token", synthetic_token(index))


def mutate_cells(
    cells: DataFrame, n: int, seed: int, pool: DataFrame, by: str = "lattice_id"
) -> tuple[DataFrame, DataFrame]:
    """Replace ``n`` distinct cells per lattice by pool draws: (new cells, change log).

    The log has (by, r, c, old, new); a draw may repeat the old token.
    """
    place = draw_integer(seed, F.col(by), F.col("r"), F.col("c"))
    order = W.partitionBy(by).orderBy("_draw", "r", "c")
    picked = (
        cells.withColumn("_draw", place)
        .withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") <= n)
        .drop("_draw", "_place")
    )
    log = draw_from_pool(picked, seed + 1, [by, "r", "c"], pool, "new").select(
        by, "r", "c", F.col("token").alias("old"), "new"
    )
    changed = cells.join(log.select(by, "r", "c", "new"), [by, "r", "c"], "left")
    return changed.select(by, "r", "c", F.coalesce("new", "token").alias("token")), log


def sample_n(df: DataFrame, key: Sequence[str], seed: int, n: int) -> DataFrame:
    """``n`` rows without replacement, those of the least draws; all of them when there are fewer.

    Threshold sampling: the row count gives a bound below which a few more than ``n`` draws are to be
    expected.  One filtered pass takes those, and only they are ranked to cut off the surplus.  Where the bound
    falls short (draws of few distinct keys) it is raised sixteenfold.
    """
    rows = df.count()
    if rows <= n:
        return df
    keyed = df.withColumn("_draw", draw_integer(seed, *[F.col(k) for k in key]))
    bound = DRAWS * (n + MARGIN * math.sqrt(n) + MARGIN) / rows
    while bound < DRAWS:
        few = keyed.filter(F.col("_draw") < F.lit(int(bound)))
        if few.count() >= n:
            break
        bound *= 16
    else:
        few = keyed
    return ranked(few, ["_draw", *key], name="_rank").filter(F.col("_rank") <= n).drop("_draw", "_rank")


def sample_between(df: DataFrame, key: Sequence[str], seed: int, low: int, high: int) -> DataFrame:
    """As :func:`sample_n`, with n itself drawn from the seed in [low, high]."""
    n = low + df.sparkSession.range(1).select(draw_integer(seed, F.lit("n"))).first()[0] % (high - low + 1)
    return sample_n(df, key, seed, n)


def weighted_assign(
    df: DataFrame, key: Sequence[str], weights: Mapping[str, float], seed: int, name: str = "label"
) -> DataFrame:
    """One label per row, drawn with relative weights."""
    total = sum(weights.values())
    draw, reached, chosen = F.col("_draw"), 0.0, None
    labels = list(weights)
    for label in labels[:-1]:
        reached += weights[label]
        limit = F.lit(reached / total)
        chosen = F.when(draw < limit, label) if chosen is None else chosen.when(draw < limit, label)
    label = F.lit(labels[-1]) if chosen is None else chosen.otherwise(labels[-1])
    drawn = df.withColumn("_draw", draw_unit(seed, *[F.col(k) for k in key]))
    return drawn.withColumn(name, label).drop("_draw")


def distinct_targets(files: Sequence[DataFrame], excluded: Sequence[str], path: str = "path") -> DataFrame:
    """Union of listings without the excluded file names, distinct, in path order."""
    union = files[0].select(path)
    for other in files[1:]:
        union = union.unionByName(other.select(path))
    kept = union.filter(~F.element_at(F.split(path, "/"), -1).isin(list(excluded)))
    return kept.distinct().orderBy(path)
