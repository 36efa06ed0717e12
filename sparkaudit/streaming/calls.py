"""Live calls: utterances cut at silences, transcripts emitted when a call has ended.

Both close a session when the watermark passes its end, so the newest session of a
stream stays open until a later event arrives; rows later than the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.operators.transcripts import TURNS_PER_PART


def stream_utterances(
    fragments: DataFrame, gap: str = "2 seconds", watermark: str = "10 seconds", call: str = "call_id"
) -> DataFrame:
    """Text fragments (call, ts, text) to utterances: (call, start, end, fragments, text)."""
    pieces = F.array_sort(F.collect_list(F.struct("ts", "text")))
    return (
        fragments.withWatermark("ts", watermark)
        .groupBy(call, F.session_window("ts", gap).alias("w"))
        .agg(pieces.alias("_p"))
        .select(
            call, F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.size("_p").alias("fragments"),
            F.array_join(F.transform("_p", lambda x: x.text), " ").alias("text"),
        )
    )


def stream_transcripts(
    turns: DataFrame,
    gap: str = "30 minutes",
    watermark: str = "10 minutes",
    by: str = "conv_id",
    per_part: int = TURNS_PER_PART,
) -> DataFrame:
    """Turns (by, turn, role, text, ts) to one row per ended call: (by, part, start, turns, transcript).

    Turn numbers are cut into parts, so the state of one call is bounded; a usual call is part 0 only.
    """
    part = F.floor(F.col("turn") / per_part).alias("part")
    spoken = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    line = F.transform("_t", lambda x: F.concat(x.role, F.lit(": "), x.text))
    return (
        turns.withWatermark("ts", watermark)
        .groupBy(by, part, F.session_window("ts", gap).alias("w"))
        .agg(spoken.alias("_t"))
        .select(
            by, "part", F.col("w.start").alias("start"), F.size("_t").alias("turns"),
            F.array_join(line, "\n").alias("transcript"),
        )
    )
