"""A continuous audit whose grades follow from an order index: a batch ranks again only the ranges it falls into.

The store is cut into ranges of the order (score, path).  Within a range every row carries
its rank there; the index has one row for each range: its lower bound, the version of its
files, and how many rows it holds.  The rank of a row in the whole store is the sum of the
counts of the ranges below plus its own, so grades are a join of the store with the index and
nothing is sorted again.

A batch replaces the rows of its paths.  The ranges that lose or get rows are read, ranked and
written under a new version; all others keep their files.  A range beyond twice ``rows_per_range`` is cut
where the rows lie.  The index of a version is written last and names the batch: a batch that
is run again finds it and does nothing, one that failed half-way leaves files that no index names.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from sparkaudit.functions import media as M
from sparkaudit.operators import audit as A
from sparkaudit.operators.ordering import SEGMENT, cut_points, in_order, with_segment
from sparkaudit.streaming.audit import judged_stream
from sparkaudit.streaming.folders import exists

ORDER = ["score", "path"]
#: A range is ranked by one task.
ROWS_PER_RANGE = 1 << 18
INDEX = "range int, low struct<score:double,path:string>, files bigint, n bigint, scoreable bigint, stream string, batch bigint"


def read_index(spark: SparkSession, store: str) -> tuple[int, list]:
    """The newest version and its ranges in order; one row for each range of the store."""
    if not exists(spark, f"{store}/index"):
        return 0, []
    versions = spark.read.schema(f"{INDEX}, version bigint").parquet(f"{store}/index")
    newest = versions.agg(F.max("version")).first()[0] or 0
    rows = versions.filter(F.col("version") == newest).collect()
    return newest, sorted(rows, key=lambda r: (r["low"] is not None, tuple(r["low"] or ())))


def current_rows(spark: SparkSession, store: str, index: list) -> DataFrame | None:
    """Rows of the ranges that the index names, with their range."""
    paths = [f"{store}/ranges/files={r['files']}/range={r['range']}" for r in index if r["n"]]
    return spark.read.option("basePath", f"{store}/ranges").parquet(*paths).drop("files") if paths else None


def start_graded_audit(
    payloads: DataFrame, store: str, checkpoint: str, rows_per_range: int = ROWS_PER_RANGE, **trigger
) -> StreamingQuery:
    """Judge probe payloads and keep the ranked store up to date, batch by batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        merge_batch(batch, store, rows_per_range, stream, batch_id)

    writer = judged_stream(payloads).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def merge_batch(batch: DataFrame, store: str, rows_per_range: int, stream: str, batch_id: int) -> None:
    """Put one batch of verdicts into the store; of several for a path the greatest row counts."""
    spark = batch.sparkSession
    version, index = read_index(spark, store)
    if index and (index[0]["stream"], index[0]["batch"]) == (stream, batch_id):
        return
    fields = [c for c in batch.columns if c != "path"]
    latest = batch.groupBy("path").agg(F.max(F.struct(*fields)).alias("_f")).select("path", "_f.*")
    latest = latest.withColumn("score", F.coalesce(F.when(~F.col("corrupt"), F.col("norm_efficiency")), F.lit(float("nan")))).persist()
    try:
        old = current_rows(spark, store, index)
        good = latest.filter(~F.col("corrupt"))
        lows = [r["low"] for r in index]
        cuts = lows[1:] if lows else cut_points(good, ORDER, rows_per_range)
        placed = with_segment(good, ORDER, cuts)
        hit = {r[0] for r in placed.select(SEGMENT).distinct().collect()} | (set() if lows else {0})
        place = {r["range"]: i for i, r in enumerate(index)}
        if old is not None:
            left = old.select("path", "range").join(latest.select("path"), "path", "left_semi").select("range").distinct()
            hit |= {place[r[0]] for r in left.collect()}
        kept = [r for i, r in enumerate(index) if i not in hit]
        touched = [r for i, r in enumerate(index) if i in hit]
        rows = placed.drop(SEGMENT)
        before = current_rows(spark, store, touched)
        if before is not None:
            rows = rows.unionByName(before.drop("range", "in_range").join(latest.select("path"), "path", "left_anti"))
        refined = split_bounds(rows, [None, *cuts] if not lows else lows, hit, rows_per_range)
        ids = {low: i for i, low in enumerate(refined, max((r["range"] for r in index), default=-1) + 1)}
        write_ranges(spark, store, version + 1, rows, refined, ids, kept, stream, batch_id)
    finally:
        latest.unpersist()


def split_bounds(rows: DataFrame, lows: list, hit: set[int], rows_per_range: int) -> list:
    """Lower bounds of the ranges that are written anew: those hit, and cuts inside the ones that have grown too large."""
    sizes = with_segment(rows, ORDER, lows[1:]).groupBy(SEGMENT).count().collect()
    out = {i: [lows[i]] for i in hit}
    grown = {r[SEGMENT] for r in sizes if r["count"] > 2 * rows_per_range}
    if grown:
        # One sample cuts all of them: its cut points are about ``rows_per_range`` rows apart wherever they lie.
        bounds = [in_order(low) for low in lows[1:]]
        for cut in cut_points(rows, ORDER, rows_per_range):
            i = bisect_right(bounds, in_order(cut))
            if i in grown and (lows[i] is None or in_order(cut) > in_order(lows[i])):
                out[i].append(cut)
    return [low for i in sorted(out) for low in out[i]]


def write_ranges(spark, store: str, version: int, rows: DataFrame, lows: list, ids: dict, kept: list, stream: str, batch_id: int) -> None:
    """Rank the rows inside the ranges with these lower bounds, write them, and then the index of all ranges."""
    bounds = sorted([*lows, *[r["low"] for r in kept]], key=lambda b: (b is not None, tuple(b or ())))
    names = {b: i for b, i in ids.items()} | {r["low"]: r["range"] for r in kept}
    numbers = F.array(*[F.lit(names[b]) for b in bounds])
    placed = with_segment(rows, ORDER, bounds[1:]).withColumn("range", F.get(numbers, F.col(SEGMENT))).drop(SEGMENT)
    # A range holds a bounded number of rows: its window is a task of ordinary size.
    ranked = placed.withColumn("in_range", F.row_number().over(W.partitionBy("range").orderBy(*ORDER)))
    ranked.write.mode("overwrite").partitionBy("range").parquet(f"{store}/ranges/files={version}")
    empty = {i: (0, 0) for i in ids.values()}
    if bounds:
        written = spark.read.schema(ranked.schema).parquet(f"{store}/ranges/files={version}")
        counts = written.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.count_if(M.is_scoreable(F.col("score"))).alias("s")).collect()
        empty |= {r["range"]: (r["n"], r["s"]) for r in counts}
    entries = [(ids[low], low, version, *empty[ids[low]], stream, batch_id) for low in lows]
    entries += [(r["range"], r["low"], r["files"], r["n"], r["scoreable"], stream, batch_id) for r in kept]
    spark.createDataFrame(entries, INDEX).coalesce(1).write.mode("overwrite").parquet(f"{store}/index/version={version}")


def graded_ranges(spark: SparkSession, store: str) -> DataFrame | None:
    """All good files with percentile and grade, by the index: equal to ``percentile_grade`` of the whole store.

    Nothing while the store holds no good file: it knows no columns then.
    """
    _, index = read_index(spark, store)
    before, entries = 0, []
    for r in index:
        entries.append((r["range"], before))
        before += r["n"]
    total = sum(r["scoreable"] for r in index)
    rows = current_rows(spark, store, index)
    if rows is None:
        return None
    ranges = spark.createDataFrame(entries, "range int, _before bigint")
    numbered = rows.join(F.broadcast(ranges), "range").withColumn("_rank", F.col("_before") + F.col("in_range"))
    graded = A.graded_by_rank(numbered, "score", F.col("_rank"), F.lit(total), M.GRADE_BANDS)
    return graded.drop("score", "range", "in_range", "_before", "_rank")
