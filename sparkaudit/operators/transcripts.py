"""Transcripts and sessions over finished tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.operators import ordering as O

TURNS_PER_PART = 10_000
FRAGMENTS_PER_PART = 1_000


def assemble_transcripts(
    turns: DataFrame, by: Sequence[str] = ("conv_id",), turn: str = "turn", per_part: int = TURNS_PER_PART
) -> DataFrame:
    """Each conversation in turn order: (by, part, turns, transcript).

    A conversation of more than ``per_part`` turns continues in further parts, so no
    row grows without bound; a usual conversation is part 0 only.
    """
    by = list(by)
    numbered = O.ranked(turns.select(*by, turn, "role", "text"), [turn, "role", "text"], by, "_rank")
    part = F.floor((F.col("_rank") - 1) / per_part).alias("part")
    listed = numbered.groupBy(*by, part).agg(
        F.array_sort(F.collect_list(F.struct("_rank", turn, "role", "text"))).alias("_turns")
    )
    line = F.transform("_turns", lambda x: F.concat(x.role, F.lit(": "), x.text))
    return listed.select(*by, "part", F.size("_turns").alias("turns"), F.array_join(line, "\n").alias("transcript"))


def gap_sessions(
    df: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str], gap_seconds: float, totals: Sequence[Column]
) -> DataFrame:
    """Sessions split where the gap to the row before reaches ``gap_seconds``: (by, session, start, end, totals)."""
    by = list(by)
    seen = O.previous_value(df, ts, [ts, *tie], by, "_before")
    wait = F.timestamp_diff("MICROSECOND", F.col("_before"), F.col(ts)) / 1e6
    marked = seen.withColumn("_opens", F.when(F.col("_before").isNull() | (wait >= gap_seconds), 1).otherwise(0))
    counted = O.running_total(marked, "_opens", [ts, *tie], by, "_opened")
    return (
        counted.withColumn("session", F.col("_opened") + F.col("_opens"))
        .groupBy(*by, "session")
        .agg(F.min(ts).alias("start"), F.max(ts).alias("end"), *totals)
    )


def utterances(
    fragments: DataFrame, gap_seconds: float = 2.0, per_part: int = FRAGMENTS_PER_PART, call: str = "call_id"
) -> DataFrame:
    """Fragments (call, ts, text) cut at silences: (call, start, end, part, fragments, text, final).

    Fragments of one utterance stand in order of time, then text.  An utterance of more than ``per_part`` of them
    continues in further parts, each with the start of the whole and its own end; the last part is ``final``.
    """
    order = ["ts", "text"]
    timed = fragments.select(call, *order).filter("ts IS NOT NULL")
    seen = O.previous_value(timed, "ts", order, [call], "_before")
    wait = F.timestamp_diff("MICROSECOND", F.col("_before"), F.col("ts")) / 1e6
    opens = F.when(F.col("_before").isNull() | (wait >= gap_seconds), 1).otherwise(0)
    counted = O.running_total(seen.withColumn("_opens", opens), "_opens", order, [call], "_opened")
    session = (F.col("_opened") + F.col("_opens")).alias("_session")
    numbered = O.ranked(counted.select(call, *order, session), order, [call, "_session"], "_rank", "_n")
    part = F.floor((F.col("_rank") - 1) / per_part).cast("int").alias("part")
    listed = numbered.groupBy(call, "_session", part).agg(
        F.array_sort(F.collect_list(F.struct("_rank", *order))).alias("_p"), F.max("_n").alias("_n"), F.max("_rank").alias("_to")
    )
    starts = listed.filter("part = 0").select(call, "_session", F.col("_p")[0]["ts"].alias("start"))
    said = F.array_join(F.filter(F.transform("_p", lambda x: x.text), lambda t: t.isNotNull()), " ")
    same = F.col("l._session") == F.col("s._session")
    joined = listed.alias("l").join(starts.alias("s"), same & F.col(f"l.{call}").eqNullSafe(F.col(f"s.{call}")))
    return joined.select(
        f"l.{call}", "s.start", F.element_at("_p", -1)["ts"].alias("end"), "part", F.size("_p").alias("fragments"),
        said.alias("text"), (F.col("_to") == F.col("_n")).alias("final"),
    )
