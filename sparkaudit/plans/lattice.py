"""One analysis run over many lattices: entropy, depth, fingerprint, dominant band and drawn actions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.functions.digests import seed_integer
from sparkaudit.operators import lattice as L
from sparkaudit.operators.sampling import sample_between, weighted_assign

# Default weights of the run's transforms.
WEIGHTS = {"annotate": 0.35, "patch": 0.30, "refactor": 0.20, "rebalance": 0.15}


def analyse(cells: DataFrame, by: str = "lattice_id") -> DataFrame:
    """One row per lattice: n, entropy, depth, dominant band."""
    whole = L.with_depth(L.shannon_entropy(cells, [by]))
    bands = L.dominant_band(L.spectral_bands(L.row_entropy(cells, by), by), by)
    return whole.join(bands.withColumnRenamed("band", "dominant_band"), by, "left")


def run_manifest(
    cells: DataFrame,
    targets: DataFrame,
    timestamp: int,
    seed: int,
    by: str = "lattice_id",
    actions: tuple[int, int] = (1, 6),
    weights: Mapping[str, float] = WEIGHTS,
) -> DataFrame:
    """Manifest rows, one per lattice, each with the same drawn actions (at most ``actions[1]``)."""
    summary = L.with_depth(L.shannon_entropy(cells, [by])).join(L.fingerprint(cells, by), by)
    drawn = weighted_assign(sample_between(targets, ["path"], seed, *actions), ["path"], weights, seed, "transform")
    entry = F.struct(F.col("path").alias("file"), "transform", F.lit("").alias("message"))
    listed = drawn.agg(F.array_sort(F.collect_list(entry))).scalar()
    return summary.select(
        by, F.lit(timestamp).cast("bigint").alias("timestamp"), F.lit(seed).cast("bigint").alias("seed"),
        F.col("fingerprint").alias("matrix_fp"), F.round("entropy", 6).alias("entropy"),
        F.round("depth", 6).alias("depth"), listed.alias("actions"),
    )


def with_seed(fingerprints: DataFrame, salt: str = "") -> DataFrame:
    return fingerprints.withColumn("seed_int", seed_integer(F.col("fingerprint"), salt))
