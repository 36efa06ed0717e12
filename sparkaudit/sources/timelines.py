"""Landed character alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.landing import landed

ALIGNMENT = (
    "struct<alignment:struct<characters:array<string>,"
    "character_start_times_seconds:array<double>,character_end_times_seconds:array<double>>>"
)


def read_alignments(df: DataFrame, by: str = "id", payload: str = "payload") -> DataFrame:
    """Alignment JSON to (by, pos, symbol, start, end, last_end, before, shared); pairs stop at the shortest array.

    An alignment with ends but no pairs is one row without a position: it still closes with a rest.
    ``before`` is the pair before in the same payload, for keys of one payload; keys of several are marked ``shared``.
    """
    counted = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) | F.col(by).isNull())
    several = landed(counted.select(F.col(by).alias("_by")))
    same = F.col(by).eqNullSafe(F.col("_by"))
    alone = _pairs(df.join(several, same, "left_anti"), by, payload).withColumn("shared", F.lit(False))
    return alone.unionByName(_pairs(df.join(several, same, "left_semi"), by, payload).withColumn("shared", F.lit(True)))


def _pairs(df: DataFrame, by: str, payload: str) -> DataFrame:
    parsed = df.select(by, F.inline(F.array(F.struct(F.from_json(F.col(payload), ALIGNMENT)["alignment"].alias("a")))))
    chars, starts, ends = F.col("a.characters"), F.col("a.character_start_times_seconds"), F.col("a.character_end_times_seconds")
    shortest = F.least(F.size(chars), F.size(starts), F.size(ends))
    later = lambda values, kind: F.concat(F.array(F.lit(None).cast(kind)), values)
    zipped = F.arrays_zip(
        chars.alias("symbol"), starts.alias("start"), ends.alias("end"),
        later(chars, "string").alias("symbol_before"), later(starts, "double").alias("start_before"),
        later(ends, "double").alias("end_before"),
    )
    rows = parsed.select(
        by, F.try_element_at(ends, F.lit(-1)).alias("last_end"),
        F.posexplode_outer(F.slice(zipped, F.lit(1), F.greatest(shortest, F.lit(0)))).alias("pos", "z"),
    )
    return rows.filter(F.col("pos").isNotNull() | F.col("last_end").isNotNull()).select(
        by, "pos", F.col("z").getField("symbol").alias("symbol"), F.col("z").getField("start").alias("start"),
        F.col("z").getField("end").alias("end"), "last_end",
        F.when(F.col("pos") > 0, F.struct(*[F.col("z").getField(f"{c}_before").alias(c) for c in ("symbol", "start", "end")])).alias("before"),
    )
