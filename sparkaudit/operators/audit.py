"""Media audit operators: scoring, verdicts, grading, joins with landed results, summaries, sorting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkaudit.functions import media as M
from sparkaudit.functions.text import fixed
from sparkaudit.landing import landed
from sparkaudit.operators.ordering import SEGMENT, cut_points, earlier_cells, in_order, later_cells, ranked, spread, with_segment

GRADE_ORDER = ["excellent", "good", "fair", "poor", "terrible", "?"]


def codec_dimension(df: DataFrame, factors: Mapping[str, float] = M.CODEC_FACTORS) -> DataFrame:
    return df.sparkSession.createDataFrame(list(factors.items()), "_codec string, codec_factor double")


def with_codec_factor(
    df: DataFrame,
    codec: str = "codec",
    factors: Mapping[str, float] | DataFrame = M.CODEC_FACTORS,
    default: float = M.DEFAULT_FACTOR,
) -> DataFrame:
    """Left lookup of the codec factor by lower-cased name.

    A mapping is driver-side data of known size and is broadcast; a DataFrame
    (codec, factor) is left to the planner.
    """
    if isinstance(factors, DataFrame):
        dim = factors.toDF("_codec", "codec_factor")
    else:
        dim = F.broadcast(codec_dimension(df, factors))
    joined = df.join(dim, F.lower(F.col(codec)) == F.col("_codec"), "left").drop("_codec")
    return joined.withColumn("codec_factor", F.coalesce("codec_factor", F.lit(default)))


def with_efficiency(
    df: DataFrame,
    bitrate: str = "bitrate_bps",
    pixels: Column | None = None,
    codec: str = "codec",
    factors: Mapping[str, float] | DataFrame = M.CODEC_FACTORS,
    default: float = M.DEFAULT_FACTOR,
) -> DataFrame:
    """Add codec_factor, raw_efficiency and norm_efficiency; infinite when not measurable."""
    area = M.pixels(F.col("width"), F.col("height")) if pixels is None else pixels
    return (
        with_codec_factor(df, codec, factors, default)
        .withColumn("raw_efficiency", M.raw_efficiency(F.col(bitrate), area))
        .withColumn("norm_efficiency", F.col("raw_efficiency") / F.col("codec_factor"))
    )


def with_verdict(probes: DataFrame) -> DataFrame:
    """Add probe_ok, corrupt, corrupt_reason and the scores; corrupt rows keep neutral scores."""
    reason = M.corrupt_reason(
        F.col("has_payload"), F.col("has_video"), F.col("duration_s"), F.col("width"), F.col("height")
    )
    judged = probes.withColumn("corrupt_reason", reason).withColumn("corrupt", F.col("corrupt_reason") != "")
    scored = with_efficiency(judged)
    sound = ~F.col("corrupt")
    return (
        scored.withColumn("codec_factor", F.when(sound, F.col("codec_factor")).otherwise(1.0))
        .withColumn("raw_efficiency", F.when(sound, F.col("raw_efficiency")).otherwise(0.0))
        .withColumn("norm_efficiency", F.when(sound, F.col("norm_efficiency")).otherwise(0.0))
        .withColumnRenamed("has_payload", "probe_ok")
        .drop("has_video")
    )


def split_verdict(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, corrupt); persist the input when both are used."""
    return df.filter(~F.col("corrupt")), df.filter(F.col("corrupt"))


def apply_decode_samples(files: DataFrame, samples: DataFrame) -> DataFrame:
    """Mark files whose decode samples failed; the earliest failing position gives the reason.

    ``samples``: path, frac, exit_code, timed_out, error.
    """
    failing = samples.filter(
        (F.coalesce("exit_code", F.lit(0)) != 0) | F.coalesce("timed_out", F.lit(False)) | F.col("error").isNotNull()
    )
    first = failing.groupBy("path").agg(
        F.min_by(F.struct("frac", "exit_code", "timed_out", "error"), "frac").alias("_f")
    )
    percent = fixed(F.col("_f.frac") * 100, 0)
    at = fixed(F.col("duration_s") * F.col("_f.frac"), 1)
    reason = (
        F.when(F.col("_f.error").isNotNull(), F.concat(F.lit("ffmpeg error: "), F.col("_f.error")))
        .when(F.col("_f.timed_out"), F.concat(F.lit("decode timed out at "), percent, F.lit("%")))
        .otherwise(F.concat(F.lit("frame decode failed at "), percent, F.lit("% ("), at, F.lit("s)")))
    )
    hit = ~F.col("corrupt") & F.col("probe_ok") & (F.col("duration_s") > 0) & F.col("_f").isNotNull()
    return (
        files.join(first, "path", "left")
        .withColumn("corrupt_reason", F.when(hit, reason).otherwise(F.col("corrupt_reason")))
        .withColumn("corrupt", F.coalesce(F.col("corrupt") | hit, F.col("corrupt")))
        .drop("_f")
    )


def attach_quality(files: DataFrame, quality: DataFrame, reference: str) -> DataFrame:
    """Left join the mean quality score by path; the reference file itself scores 100."""
    one_each = quality.groupBy("path").agg(F.max("vmaf_mean").alias("vmaf_mean"))
    score = F.when(F.col("path") == reference, F.lit(100.0)).otherwise(F.col("vmaf_mean"))
    return (
        files.drop("vmaf_mean", "vmaf_reference")
        .join(one_each, "path", "left")
        .withColumn("vmaf_mean", score)
        .withColumn("vmaf_reference", F.lit(reference))
    )


def percentile_grade(
    df: DataFrame,
    score: str = "norm_efficiency",
    tie: Sequence[str] = ("path",),
    bands: list[tuple[float, str]] = M.GRADE_BANDS,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Add percentile (rank / n * 100, ascending) and grade among the scoreable rows.

    Infinite scores sort behind every finite one, so one ranking serves both;
    they get 100 and ``?`` and do not count towards n.
    """
    keyed = df.withColumn("_score", F.coalesce(F.col(score), F.lit(float("nan"))))
    numbered = ranked(
        keyed, ["_score", *tie], partition_by, "_rank", "_n", M.is_scoreable(F.col("_score"))
    )
    graded = graded_by_rank(numbered, "_score", F.col("_rank"), F.col("_n"), bands)
    return graded.drop("_score", "_rank", "_n")


def graded_by_rank(numbered: DataFrame, score: str, rank: Column, n: Column, bands: list[tuple[float, str]] = M.GRADE_BANDS) -> DataFrame:
    """Add percentile and grade of rows that know their rank among ``n`` scoreable ones; unscored ones have a NaN."""
    finite, infinite = M.is_scoreable(F.col(score)), F.col(score) == float("inf")
    alone = n < 2
    percentile = F.when(finite & alone, 50.0).when(finite, rank / n * 100.0)
    grade = F.when(infinite | (finite & alone), M.UNGRADED).when(finite, M.grade_of(F.col("percentile"), bands))
    return numbered.withColumn("percentile", percentile.when(infinite, 100.0).otherwise(0.0)).withColumn("grade", grade.otherwise(""))


def audit_summary(df: DataFrame) -> DataFrame:
    """One row: scanned, valid, corrupt, total_bytes, valid_bytes, any_corrupt."""
    valid = ~F.col("corrupt")
    return df.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(valid).alias("valid"),
        F.count_if(F.col("corrupt")).alias("corrupt"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum(F.when(valid, F.col("size_bytes"))), F.lit(0)).alias("valid_bytes"),
        F.coalesce(F.bool_or("corrupt"), F.lit(False)).alias("any_corrupt"),
    )


def codec_counts(good: DataFrame, codec: str = "codec") -> DataFrame:
    return good.groupBy(codec).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), codec)


def grade_counts(good: DataFrame, grade: str = "grade", order: Sequence[str] = GRADE_ORDER) -> DataFrame:
    """Count per grade in report order; grades that do not occur are absent."""
    counted = good.groupBy(grade).agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*[F.lit(g) for g in order]), F.col(grade))
    return counted.filter(place > 0).orderBy(place)


def extremes(df: DataFrame, score: str, path: str, best: str = "min") -> DataFrame:
    """One row: mean, best and worst of a score with their paths; equal scores go to the smallest path."""
    low = F.min_by(F.struct(path, score), F.struct(score, path))
    high = F.min_by(F.struct(path, score), F.struct(-F.col(score), F.col(path)))
    ends = (low, high) if best == "min" else (high, low)
    return df.agg(F.avg(score).alias("mean"), ends[0].alias("_b"), ends[1].alias("_w")).select(
        "mean",
        F.col(f"_b.{path}").alias("best_path"),
        F.col(f"_b.{score}").alias("best"),
        F.col(f"_w.{path}").alias("worst_path"),
        F.col(f"_w.{score}").alias("worst"),
    )


def efficiency_extremes(good: DataFrame, score: str = "norm_efficiency", path: str = "path") -> DataFrame:
    return extremes(good.filter(M.is_scoreable(F.col(score))), score, path, "min")


def quality_extremes(good: DataFrame, score: str = "vmaf_mean", path: str = "path") -> DataFrame:
    return extremes(good.filter(F.col(score).isNotNull()), score, path, "max")


def sort_keys(key: str) -> list[Column]:
    """Columns of a report sort key, all ascending."""
    plain = {
        "size": F.col("size_bytes"),
        "bitrate": F.col("bitrate_bps"),
        "codec": F.col("codec"),
        "fps": F.col("fps"),
        "duration": F.col("duration_s"),
    }
    if key in plain:
        return [plain[key]]
    if key == "efficiency":
        return [F.col("norm_efficiency") == float("inf"), F.col("norm_efficiency")]
    if key == "vmaf":
        return [F.col("vmaf_mean").isNull(), -F.coalesce("vmaf_mean", F.lit(0.0))]
    if key == "resolution":
        return [M.pixels(F.col("width"), F.col("height"))]
    if key == "name":
        return [F.lower(M.file_name(F.col("path")))]
    raise ValueError(f"unknown sort key: {key}")


def sort_order(key: str, desc: bool = False) -> list[Column]:
    """Sort expressions; ``desc`` turns the whole key round, equal keys stay in path order."""
    keys = [k.desc() if desc else k.asc() for k in sort_keys(key)]
    return [*keys, F.split("path", "/").asc()]


def sort_report(df: DataFrame, key: str = "efficiency", desc: bool = False) -> DataFrame:
    return df.orderBy(*sort_order(key, desc))


SORT_KEYS = ("efficiency", "vmaf", "size", "bitrate", "codec", "fps", "duration", "resolution", "name")


#: What a key's columns are ranked by, of whatever type they are, and then the path.
PARTS = {"_whole": "bigint", "_real": "double", "_text": "string"}
PLACE_ORDER = [*PARTS, "_path_key"]


def path_key(path: Column) -> Column:
    """Text that sorts as the path's components do: the separator becomes the least character, which others make room for."""
    room = F.replace(F.replace(path, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    return F.replace(room, F.lit("/"), F.lit("\x00"))


def report_places(df: DataFrame, keys: Sequence[str] = SORT_KEYS) -> DataFrame:
    """Each path's place (from 1) in the order of ``sort_report``: (sort_key, turned, path, place) for all keys and both directions.

    All keys are ranked together, by ranges, so nothing is sorted in one task.  Turned round, a row comes after all
    rows of greater keys, and among equal ones still by path.  One shuffle serves both directions: windows of a cell count the rows
    below and up to a row's equals there, and one small row per cell tells their equals in other cells.
    """
    kinds = {"string": "_text", "double": "_real", "float": "_real"}
    entries = []
    for key in keys:
        columns = sort_keys(key)
        types = [f.dataType.simpleString() for f in df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).schema]
        own = {kinds.get(t, "_whole"): c for c, t in zip(columns, types)}
        entries.append(F.struct(F.lit(key).alias("sort_key"), *[own.get(p, F.lit(None)).cast(t).alias(p) for p, t in PARTS.items()]))
    rows = spread(df).select("path", path_key(F.col("path")).alias("_path_key"), F.inline(F.array(*entries)))
    cuts = cut_points(rows, PLACE_ORDER)
    # Finding a row's range is most of the work: it is done once for the counts and the windows.
    segmented = landed(with_segment(rows, PLACE_ORDER, cuts))
    cell = W.partitionBy("sort_key", SEGMENT)
    numbered = segmented.withColumn("_row", F.row_number().over(cell.orderBy(*PLACE_ORDER)))
    # Ordered by the key's columns alone, after the window above: its sort serves these too.
    equals = cell.orderBy(*PARTS)
    numbered = numbered.withColumns({"_below": F.rank().over(equals) - 1, "_up_to": F.count(F.lit(1)).over(equals)})
    counted = numbered.join(F.broadcast(_cell_counts(segmented, cuts)), ["sort_key", SEGMENT])
    place = F.col("_before") + F.col("_row")
    below = F.col("_before") + F.col("_below") - F.when(F.col("_below") == 0, F.col("_head")).otherwise(0)
    up_to = F.col("_before") + F.col("_up_to") + F.when(F.col("_up_to") == F.col("_in"), F.col("_tail")).otherwise(0)
    turned = F.col("_all") - up_to + place - below
    both = F.array(*[F.struct(F.lit(t).alias("turned"), p.cast("bigint").alias("place")) for t, p in ((False, place), (True, turned))])
    return counted.select("sort_key", "path", F.inline(both))


def _cell_counts(segmented: DataFrame, cuts: list) -> DataFrame:
    """One row per cell: its rows, those of the cells before, of all cells, and the equals of its first and last rows elsewhere.

    Rows that are equal but for the path lie in several cells only where a cut point has their key, so
    each cell counts those of the cut at its lower and at its upper end.
    """
    spark = segmented.sparkSession
    ends = [None, *(tuple(c)[: len(PARTS)] for c in cuts), None]
    number: dict = {}
    ids = [None if e is None else number.setdefault(in_order(e), len(number)) for e in ends]
    kind = ",".join(f"{p}:{t}" for p, t in PARTS.items())
    bounds = spark.createDataFrame(
        [(i, ends[i], ends[i + 1], ids[i], ids[i + 1]) for i in range(len(cuts) + 1)],
        f"_cell int, _low struct<{kind}>, _high struct<{kind}>, _low_id int, _high_id int",
    )
    key = F.struct(*PARTS)
    placed = segmented.join(F.broadcast(bounds), F.col(SEGMENT) == F.col("_cell"))
    sizes = landed(placed.groupBy("sort_key", SEGMENT).agg(
        F.count(F.lit(1)).alias("_in"), F.first("_low_id").alias("_low_id"), F.first("_high_id").alias("_high_id"),
        F.count_if(F.col("_low_id").isNotNull() & key.eqNullSafe(F.col("_low"))).alias("_low_n"),
        F.count_if(F.col("_high_id").isNotNull() & key.eqNullSafe(F.col("_high"))).alias("_high_n"),
    ))
    entry = lambda end: F.struct(F.col(f"_{end}_id").alias("_id"), F.col(f"_{end}_n").alias("_equal"))
    # A cell of equal rows alone may have them at both ends: they count once.
    shared = sizes.select("sort_key", SEGMENT, F.inline(F.array_distinct(F.array(entry("low"), entry("high"))))).filter("_equal > 0")
    shared = shared.select(
        "sort_key", SEGMENT, "_id",
        F.coalesce(F.sum("_equal").over(earlier_cells(["sort_key", "_id"])), F.lit(0)).alias("_earlier"),
        F.coalesce(F.sum("_equal").over(later_cells(["sort_key", "_id"])), F.lit(0)).alias("_later"),
    )
    end = lambda e, n, name: shared.select("sort_key", SEGMENT, F.col("_id").alias(f"_{e}_id"), F.col(n).alias(name))
    known = (
        sizes.join(end("low", "_earlier", "_head"), ["sort_key", SEGMENT, "_low_id"], "left")
        .join(end("high", "_later", "_tail"), ["sort_key", SEGMENT, "_high_id"], "left")
    )
    return known.select(
        "sort_key", SEGMENT, "_in",
        F.coalesce(F.sum("_in").over(earlier_cells(["sort_key"])), F.lit(0)).alias("_before"),
        F.sum("_in").over(W.partitionBy("sort_key")).alias("_all"),
        F.coalesce("_head", F.lit(0)).alias("_head"), F.coalesce("_tail", F.lit(0)).alias("_tail"),
    )


def path_order(df: DataFrame, path: str = "path") -> DataFrame:
    """Component-wise path order."""
    return df.orderBy(F.split(path, "/"))


def filter_report(df: DataFrame, name: str, text: str = "", only: Column | None = None) -> DataFrame:
    """Rows whose name holds ``text`` in any case and, if given, meet ``only``."""
    hit = F.contains(F.lower(F.col(name)), F.lit(text.lower()))
    return df.filter(hit if only is None else hit & only)


def is_bloated(grade: str = "grade") -> Column:
    return F.col(grade).isin("poor", "terrible")
