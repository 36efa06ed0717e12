"""Token lattice operators.  A lattice is a long table (lattice_id, r, c, token)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.functions import numeric as N
from sparkaudit.functions.digests import sorted_digests
from sparkaudit.operators.ordering import attach_group

BANDS = 8
#: Tasks that share the runs of one column.
DEALT = 4
DIGEST_FAN_IN = 1024
DIGEST_LEVELS = 3


def token_frequencies(df: DataFrame, by: Sequence[str] = (), token: str = "token") -> DataFrame:
    return df.groupBy(*by, token).agg(F.count(F.lit(1)).alias("n"))


def shannon_entropy(df: DataFrame, by: Sequence[str] = (), token: str = "token") -> DataFrame:
    """Entropy in bits per group: log2(n) - sum(c log2 c) / n over the token counts c.

    Two grouped sums; a frequent token shrinks to one row per task before the shuffle.
    """
    counts = token_frequencies(df, by, token)
    n, weighted = F.sum("n"), F.sum(F.col("n") * F.log2("n"))
    entropy = F.when(n > 0, F.log2(n) - weighted / n).otherwise(0.0)
    return counts.groupBy(*by).agg(F.coalesce(n, F.lit(0)).alias("n"), entropy.alias("entropy"))


def row_entropy(cells: DataFrame, by: str = "lattice_id") -> DataFrame:
    """A row has a fixed number of columns, so one shuffle by row serves both grouping steps."""
    return shannon_entropy(cells.repartition(by, "r"), [by, "r"])


def column_entropy(cells: DataFrame, by: str = "lattice_id") -> DataFrame:
    """Of cells, or of runs (by, c, tokens) of a column's tokens, as many to a column as there are; their tokens hold no blanks.

    Runs are shuffled as text, a fraction of what rows of single tokens take.  The tokens of a column are dealt
    by a hash over ``DEALT`` tasks, so that a lattice of very many runs is not one task a column.
    """
    if "tokens" not in cells.columns:
        return shannon_entropy(cells, [by, "c"])
    share = lambda s: F.array_join(F.filter("tokens", lambda t: F.pmod(F.hash(t), F.lit(DEALT)) == s), " ")
    shares = F.transform(F.sequence(F.lit(0), F.lit(DEALT - 1)), share)
    dealt = cells.select(by, "c", F.posexplode(shares).alias("_share", "_text")).filter("_text <> ''")
    key = [by, "c", "_share"]
    tokens = dealt.repartition(*key).select(*key, F.explode(F.split("_text", " ")).alias("token"))
    sums = token_frequencies(tokens, key).groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("_w"))
    n, weighted = F.sum("n"), F.sum("_w")
    return sums.groupBy(by, "c").agg(n.alias("n"), (F.log2(n) - weighted / n).alias("entropy"))


def spectral_bands(rows: DataFrame, by: str = "lattice_id", bands: int = BANDS) -> DataFrame:
    """Mean row entropy per band of max(1, rows // bands) rows; later rows are left out, an empty band is 0."""
    sizes = rows.groupBy(by).agg((F.max("r") + 1).alias("_rows"))
    size = F.greatest(F.lit(1), F.floor(F.col("_rows") / bands))
    placed = attach_group(rows, sizes, [by]).withColumn("band", F.floor(F.col("r") / size).cast("int"))
    means = placed.filter(F.col("band") < bands).groupBy(by, "band").agg(F.avg("entropy").alias("_mean"))
    every = sizes.select(by, F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    return every.join(means, [by, "band"], "left").select(
        by, "band", F.coalesce("_mean", F.lit(0.0)).alias("mean_entropy")
    )


def dominant_band(bands: DataFrame, by: str = "lattice_id") -> DataFrame:
    """Band of the highest mean, the first on ties."""
    top = F.max_by("band", F.struct("mean_entropy", -F.col("band")))
    return bands.groupBy(by).agg(top.alias("band"))


def with_depth(df: DataFrame, low: float = N.ENTROPY_FLOOR, high: float = N.ENTROPY_CEILING) -> DataFrame:
    return df.withColumn("depth", N.depth_of(F.col("entropy"), low, high))


def row_texts(cells: DataFrame, by: str = "lattice_id") -> DataFrame:
    """(by, r, text): the tokens of each row joined by a space.  A row has a fixed number of columns."""
    ordered = F.array_sort(F.collect_list(F.struct("c", "token")))
    return cells.groupBy(by, "r").agg(F.array_join(F.transform(ordered, lambda x: x.token), " ").alias("text"))


def fingerprint(cells: DataFrame, by: str = "lattice_id") -> DataFrame:
    """BLAKE2s-64 of each lattice's tokens in row order.

    The digest is sequential by definition, so a lattice passes through one task; it
    does so as a sorted stream with constant memory.  Use :func:`tree_fingerprint`
    where single lattices are too long for that.
    """
    kind = cells.schema[by].dataType
    ordered = (
        row_texts(cells, by)
        .withColumnRenamed(by, "lattice_id")
        .repartition("lattice_id")
        .sortWithinPartitions("lattice_id", "r")
        # As text the key keeps its value beside null keys.
        .select(F.col("lattice_id").cast("string"), "text")
    )
    digests = ordered.mapInPandas(sorted_digests(), "lattice_id string, fingerprint string")
    return digests.select(F.col("lattice_id").cast(kind).alias(by), "fingerprint")


def tree_fingerprint(
    cells: DataFrame, by: str = "lattice_id", fan_in: int = DIGEST_FAN_IN, levels: int = DIGEST_LEVELS
) -> DataFrame:
    """SHA-256 tree over the row texts: each level digests up to ``fan_in`` digests of the level below.

    No task ever holds more than ``fan_in`` digests.  There are ``levels`` levels, or as many more as the
    longest lattice needs to end in one node.
    """
    longest = (cells.agg(F.max("r")).first()[0] or 0) + 1
    while fan_in**levels < longest:
        levels += 1
    nodes = row_texts(cells, by).select(by, F.col("r").cast("bigint").alias("_i"), F.sha2("text", 256).alias("_d"))
    for _ in range(levels):
        parent = F.floor(F.col("_i") / fan_in).alias("_i")
        ordered = F.array_sort(F.collect_list(F.struct("_i", "_d")))
        joined = F.array_join(F.transform(ordered, lambda x: x["_d"]), "")
        nodes = nodes.select(by, parent.alias("_p"), "_i", "_d").groupBy(by, "_p").agg(
            F.sha2(joined, 256).alias("_d")
        ).withColumnRenamed("_p", "_i")
    return nodes.select(by, F.col("_d").alias("fingerprint"))


def lattice_delta(left: DataFrame, right: DataFrame, by: str = "lattice_id") -> DataFrame:
    """Cells that differ between two sets of lattices of equal shape; unequal shapes raise an error.

    A full join on position: a cell that only one side has proves unequal shapes.  Rows of cells (by, r, tokens) are
    joined as such, one key for all cells of a row.
    """
    runs = "tokens" in left.columns
    place, value = ([by, "r"], "tokens") if runs else ([by, "r", "c"], "token")
    a = left.select(*place, F.col(value).alias("_a"))
    b = right.select(*place, F.col(value).alias("_b"))
    joined = a.join(b, place, "full_outer")
    if runs:
        differ = F.size(F.filter(F.arrays_zip("_a", "_b"), lambda x: x["_a"] != x["_b"])).cast("bigint")
        null = lambda c: F.col(c).isNull() | F.exists(c, lambda t: t.isNull())
        # Rows of several lattices of one key meet crosswise; a cell is without a partner beyond the longest row of the other side.
        rows = joined.groupBy(*place).agg(
            F.coalesce(F.sum(differ), F.lit(0)).alias("_n"), F.count_if(null("_a") | null("_b")).alias("_null"),
            F.max(F.size("_a")).alias("_longest_a"), F.max(F.size("_b")).alias("_longest_b"),
        )
        uneven = (F.col("_null") > 0) | ~F.col("_longest_a").eqNullSafe(F.col("_longest_b"))
        counts = rows.groupBy(by).agg(F.sum("_n").alias("delta"), F.count_if(uneven).alias("_odd"))
    else:
        counts = joined.groupBy(by).agg(
            F.count_if(F.col("_a") != F.col("_b")).alias("delta"),
            F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("_odd"),
        )
    fault = F.raise_error("lattice dimensions must match for a delta").cast("bigint")
    return counts.select(by, F.when(F.col("_odd") == 0, F.col("delta")).otherwise(fault).alias("delta"))


def cell(cells: DataFrame, r: int, c: int) -> DataFrame:
    return cells.filter((F.col("r") == r) & (F.col("c") == c))


def row(cells: DataFrame, r: int) -> DataFrame:
    return cells.filter(F.col("r") == r)


def column(cells: DataFrame, c: int) -> DataFrame:
    return cells.filter(F.col("c") == c)


def diagonal(cells: DataFrame, cols: int, offset: int = 0) -> DataFrame:
    return cells.filter(F.col("c") == F.pmod(F.col("r") + offset, F.lit(cols)))


def validated_set(
    cells: DataFrame, updates: DataFrame, by: str = "lattice_id", length: int = 5, order: str | None = None
) -> DataFrame:
    """Replace the tokens of the updated cells.

    Of several updates of a cell the one last by ``order`` holds (without an order column, the
    greatest token).  A token of the wrong length and a cell outside the lattice raise an error.
    """
    fault = F.raise_error(F.concat(F.lit(f"token must be exactly {length} characters, got "), F.length("token"))).cast("string")
    checked = updates.select(
        by, "r", "c", F.when(F.length("token") == length, F.col("token")).otherwise(fault).alias("_new"),
        (F.col(order) if order else F.lit(0)).alias("_order"),
    )
    place = [by, "r", "c"]
    last = checked.groupBy(*place).agg(F.max_by("_new", F.struct("_order", "_new")).alias("_new"))
    outside = F.raise_error(F.lit("update outside the lattice")).cast("string")
    return cells.withColumn("_is", F.lit(True)).join(last, place, "full_outer").select(
        *place, F.when(F.col("_is").isNull(), outside).otherwise(F.coalesce("_new", "token")).alias("token")
    )
