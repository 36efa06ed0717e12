"""Ordered work on groups of any size.

A plain ``Window.partitionBy(group)`` puts a whole group in one task, and an
unpartitioned window puts the whole table there.  The operators below first
cut the *order key* into ranges that hold about the same number of rows of the
whole table.  A (group, range) cell can then never hold more rows than a range,
unless they share group and key, however the rows are spread over the groups, so
windows run per cell and only one small carry row per cell moves state from one
cell to the next.  Tables of every size go this way, in ``LEAST_SEGMENTS`` ranges at least.

The cut points come from a sample picked by a hash of the whole row, so rows that
share an order key are not sampled together, and a task that is run again after a
lost executor puts every row in the same cell.  The number of sampled rows follows the number of
ranges, not the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

ROWS_PER_SEGMENT = 1_000_000
#: Without groups there is one cell a range, so ranges are finer: each is a task, and few of them leave cores idle.
ROWS_PER_TASK = 1 << 17
LEAST_SEGMENTS = 4
#: Beyond so many ranges they grow evenly; windows stream through a sorted cell, so that costs time, not memory.
MOST_SEGMENTS = 1 << 16
SAMPLES_PER_SEGMENT = 24
#: Rows that one pass picks: enough for 64 ranges.
SAMPLED = 64 * SAMPLES_PER_SEGMENT
HASH_SPACE = 1 << 40
SALTS = 16

SEGMENT = "_segment"
IS_ROW = "_is_row"


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer splits than cores to all cores, ahead of costly work per row.

    A file of a single row group is one task however many cores wait.  A table with
    enough splits is left as it is, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def rows_per_segment(df: DataFrame, rows: int = ROWS_PER_SEGMENT) -> int:
    conf = df.sparkSession.conf.get("spark.sparkaudit.rowsPerSegment", None)
    return int(conf) if conf else rows


def _key(cols: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def _hashable(df: DataFrame) -> list[str]:
    """Columns that a hash can take: all but those with maps or variants inside."""
    return [f.name for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]


def in_order(key: Sequence) -> tuple:
    """A key's values as Spark orders them: null first, not-a-number last, texts by their bytes."""
    return tuple(_value_in_order(v) for v in key)


def _value_in_order(value) -> tuple:
    if value is None:
        return (0,)
    if isinstance(value, float):
        return (1, value != value, 0.0 if value != value else value)
    if isinstance(value, str):
        return (1, value.encode("utf-8", "surrogatepass"))
    if isinstance(value, (list, tuple)):
        return (1, [_value_in_order(v) for v in value])
    return (1, value)


def cut_points(df: DataFrame, order: Sequence[str], rows: int = ROWS_PER_SEGMENT) -> list:
    """Ascending, distinct cut points of the order key, at about equal numbers of rows.

    One pass: the rows are counted while those of the smallest hashes are picked, which are a sample.
    Beyond what ``SAMPLED`` rows can cut, a second pass samples at the rate that the count asks for.
    """
    counted = Observation()
    place = F.pmod(F.xxhash64(*[F.col(c) for c in _hashable(df)]), F.lit(HASH_SPACE))
    placed = df.observe(counted, F.count(F.lit(1)).alias("n")).select(_key(order).alias("key"), place.alias("place"))
    picked = placed.orderBy("place").limit(SAMPLED).select("key").collect()
    n = counted.get["n"]
    segments = min(MOST_SEGMENTS, max(LEAST_SEGMENTS, -(-n // rows_per_segment(df, rows))))
    wanted = segments * SAMPLES_PER_SEGMENT
    if wanted <= SAMPLED or n <= SAMPLED:
        equal = groupby(sorted((r["key"] for r in picked), key=in_order), key=in_order)
        keys = [{"key": same[0], "count": len(same)} for same in (list(g) for _, g in equal)]
    else:
        sample = df.filter(place < F.lit(int(HASH_SPACE * min(1.0, wanted / n))))
        keys = sample.groupBy(_key(order).alias("key")).count().orderBy("key").collect()
    step = sum(r["count"] for r in keys) / segments
    cuts, seen, bound = [], 0, step
    for r in keys:
        if seen and seen >= bound:
            cuts.append(r["key"])
            bound = (seen // step + 1) * step
        seen += r["count"]
    return cuts


def with_segment(df: DataFrame, order: Sequence[str], cuts: list | None = None) -> DataFrame:
    """Add ``_segment``: how many cut points lie at or below the row's order key."""
    cuts = cut_points(df, order) if cuts is None else cuts
    if not cuts:
        return df.withColumn(SEGMENT, F.lit(0))
    key_type = T.StructType([T.StructField(c, df.schema[c].dataType) for c in order])
    schema = T.StructType([T.StructField("cuts", T.ArrayType(key_type))])
    known = df.sparkSession.createDataFrame([([tuple(c) for c in cuts],)], schema)
    strides = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    key = _key(order)
    # Binary search over the cut points: one comparison per stride.
    found = F.aggregate(
        strides,
        F.lit(0),
        lambda below, stride: F.when(
            F.try_element_at("_cuts", below + stride) <= key, below + stride
        ).otherwise(below),
    )
    return df.withColumn("_cuts", known.scalar()).withColumn(SEGMENT, found).drop("_cuts")


def cells(by: Sequence[str], order: Sequence[str], descending: bool = False) -> W:
    """Window over one (group, segment) cell with its carry row in front."""
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    return W.partitionBy(*by, SEGMENT).orderBy(F.col(IS_ROW), *keys)


def with_carry(segmented: DataFrame, carry: DataFrame) -> DataFrame:
    """Put one carry row per cell in front of the cell's rows.

    A union rather than a join: it needs no second shuffle of the large side and
    keeps rows whose group key is null.
    """
    return segmented.withColumn(IS_ROW, F.lit(1)).unionByName(
        carry.withColumn(IS_ROW, F.lit(0)), allowMissingColumns=True
    )


def only_rows(df: DataFrame, *helpers: str) -> DataFrame:
    return df.filter(F.col(IS_ROW) == 1).drop(IS_ROW, SEGMENT, *helpers)


def earlier_cells(by: Sequence[str]) -> W:
    """Frame over the cells of a group that come before the present one.

    It runs on the carry table, which has at most ``MOST_SEGMENTS`` rows per group.
    """
    return W.partitionBy(*(by or [F.lit(0)])).orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)


def later_cells(by: Sequence[str]) -> W:
    return (
        W.partitionBy(*(by or [F.lit(0)]))
        .orderBy(F.col(SEGMENT).desc())
        .rowsBetween(W.unboundedPreceding, -1)
    )


def ranked(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "rank",
    total: str | None = None,
    counted: Column | None = None,
) -> DataFrame:
    """1-based dense row number in ascending ``order``, per group or over the whole table.

    ``order`` must identify a row within its group.  With ``total`` the number of
    rows of the group for which ``counted`` holds is added as well.
    """
    by = list(by)
    tally = F.count_if(F.lit(True) if counted is None else counted)
    segmented = with_segment(df, order, cut_points(df, order, ROWS_PER_SEGMENT if by else ROWS_PER_TASK))
    group = W.partitionBy(*(by or [F.lit(0)]))
    carry = (
        segmented.groupBy(*by, SEGMENT)
        .agg(F.count(F.lit(1)).alias("_n"), tally.alias("_tally"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier_cells(by)), F.lit(0)))
        .withColumn("_total", F.sum("_tally").over(group))
        .drop("_n", "_tally")
    )
    w = cells(by, order)
    out = with_carry(segmented, carry).withColumn(
        name, F.row_number().over(w) - 1 + F.first("_before").over(w)
    )
    if total:
        out = out.withColumn(total, F.first("_total").over(w))
    return only_rows(out, "_before", "_total")


def running_total(
    df: DataFrame, amount: str, order: Sequence[str], by: Sequence[str] = (), name: str = "before"
) -> DataFrame:
    """Sum of ``amount`` over all earlier rows of the group (0 for the first row)."""
    by = list(by)
    segmented = with_segment(df, order)
    carry = (
        segmented.groupBy(*by, SEGMENT)
        .agg(F.sum(amount).alias("_in_cell"))
        .withColumn("_carried", F.sum("_in_cell").over(earlier_cells(by)))
        .drop("_in_cell")
    )
    joined = with_carry(segmented, carry).withColumn(
        "_step", F.coalesce(F.when(F.col(IS_ROW) == 1, F.col(amount)).otherwise(F.col("_carried")), F.lit(0))
    )
    total = F.sum("_step").over(cells(by, order).rowsBetween(W.unboundedPreceding, -1))
    return only_rows(joined.withColumn(name, total), "_carried", "_step")


def previous_value(
    df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), name: str = "previous"
) -> DataFrame:
    """Value of the row just before, null for the first row of a group."""
    by = list(by)
    segmented = with_segment(df, order)
    carry = (
        segmented.groupBy(*by, SEGMENT)
        .agg(F.max_by(F.struct(value), _key(order)).alias("_tail"))
        .withColumn("_carried", F.last("_tail").over(earlier_cells(by)))
        .drop("_tail")
    )
    joined = with_carry(segmented, carry).withColumn(
        "_src", F.when(F.col(IS_ROW) == 1, F.struct(value)).otherwise(F.col("_carried"))
    )
    before = F.lag("_src").over(cells(by, order))
    return only_rows(joined.withColumn(name, before[value]), "_carried", "_src")


def order_statistics(
    df: DataFrame, value: str, tie: Sequence[str], share: float, by: Sequence[str] = (), name: str = "value"
) -> DataFrame:
    """Exact percentile with linear interpolation between the two nearest ranks.

    Selection by ranges, not by sorting: rows are counted per (group, range) cell, the counts tell which
    cells (two of a group at most) hold the two ranks, and only the rows of those are put in order.
    The built-in exact percentile keeps every distinct value of a group in one aggregation buffer.
    """
    by = list(by)
    segmented = with_segment(df.select(*by, value, *tie), [value, *tie])
    sizes = segmented.groupBy(*by, SEGMENT).agg(F.count(F.lit(1)).alias("_in"))
    placed = sizes.withColumns({
        "_before": F.coalesce(F.sum("_in").over(earlier_cells(by)), F.lit(0)),
        "_n": F.sum("_in").over(W.partitionBy(*(by or [F.lit(0)]))),
    })
    place = (F.col("_n") - 1) * F.lit(float(share))
    low, high = F.floor(place), F.ceil(place)
    near = placed.filter((F.col("_before") <= high) & (F.col("_before") + F.col("_in") > low)).drop("_in")
    if by:
        renamed = near.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(SEGMENT).alias("_cell"), "_before", "_n")
        same = F.col(SEGMENT) == F.col("_cell")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        held = segmented.join(renamed, same)
    else:
        known = {r[SEGMENT]: r for r in near.collect()}  # two cells at most
        held = segmented.filter(F.col(SEGMENT).isin(list(known)))
        for name_ in ("_before", "_n"):
            each = [x for k, r in known.items() for x in (F.lit(k), F.lit(r[name_]))]
            held = held.withColumn(name_, F.element_at(F.create_map(*each), F.col(SEGMENT)) if each else F.lit(0))
    inside = W.partitionBy(*by, SEGMENT).orderBy(value, *tie)
    rank = F.row_number().over(inside) - 1 + F.col("_before")
    picked = held.withColumn("_rank", rank).filter((F.col("_rank") == low) | (F.col("_rank") == high))
    least, most = F.min(value), F.max(value)
    return picked.groupBy(*by).agg((least + (most - least) * F.max(place - low)).alias(name))


def attach_group(df: DataFrame, per_group: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join one row per group to the rows of the group; a single row is one scalar subquery.

    The group's row is repeated for each of ``SALTS`` salts and the rows of a group are dealt over
    them, so a hot group meets its row in many tasks, and a later grouping on a finer key sums
    up in each of them before it shuffles.
    """
    if by:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in _hashable(df)]), F.lit(SALTS))
        every = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        return df.withColumn("_salt", salt).join(every, [*by, "_salt"], "left").drop("_salt")
    whole = per_group.select(F.struct(*per_group.columns)).scalar()
    return df.withColumn("_whole", whole).select(*df.columns, "_whole.*")
