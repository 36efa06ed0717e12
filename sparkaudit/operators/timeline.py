"""Keyframe timelines: building them, merging and pruning them, and reading them at any time.

A keyframe row has a timeline key, ``t`` and a tie-breaking ``seq``.  Ordered steps
run on cells of the time axis (see ``ordering``), so one timeline may hold any
share of all rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkaudit.functions.numeric import lerp, smoothstep
from sparkaudit.functions.symbols import symbol_of, symbols_of, words_of
from sparkaudit.operators import ordering as O

# Fixed values, in seconds: timing of generated keyframes.
SHORTEST = 0.01
RELEASE = 0.035
FINAL_REST = 0.3
RAMP = 0.08
HOLD = 0.35
WORD_GAP = 0.15
FADE = 0.12
STALE_AFTER = 2.0

BLENDED = ["viseme_weight", "emotion_blend", "head_yaw", "head_pitch", "head_roll"]
SWITCHED = ["viseme_index", "emotion_a", "emotion_b"]


def asof_bracket(
    probes: DataFrame,
    keyframes: DataFrame,
    by: Sequence[str],
    t: str = "t",
    seq: str = "seq",
    probe_time: str = "now",
) -> DataFrame:
    """Each probe with ``prev`` (last keyframe at or before it) and ``next`` (first one after it).

    One shuffle of probes and keyframes together.  Cells carry their last keyframe to the
    later cells of the timeline and their first one to the earlier cells.
    """
    by = list(by)
    fields = [c for c in keyframes.columns if c not in by]
    frames = keyframes.select(
        *by, F.col(t).cast("double").alias("_t"), F.lit(0).alias("_probe"), F.col(seq).cast("bigint").alias("_seq"),
        F.struct(*fields).alias("_frame"),
    )
    others = [c for c in probes.columns if c not in by]
    asked = probes.select(
        *by, F.col(probe_time).cast("double").alias("_t"), F.lit(1).alias("_probe"),
        F.lit(0).cast("bigint").alias("_seq"), F.struct(*others).alias("_asked"),
    )
    both = frames.unionByName(asked, allowMissingColumns=True)
    order = ["_t", "_probe", "_seq"]
    segmented = O.with_segment(both, order)
    place = F.struct(*order)
    carry = (
        segmented.groupBy(*by, O.SEGMENT)
        .agg(
            F.max_by("_frame", F.when(F.col("_probe") == 0, place)).alias("_last"),
            F.min_by("_frame", F.when(F.col("_probe") == 0, place)).alias("_first"),
        )
        .withColumn("_earlier", F.last("_last", ignorenulls=True).over(O.earlier_cells(by)))
        .withColumn("_later", F.last("_first", ignorenulls=True).over(O.later_cells(by)))
        .drop("_last", "_first")
    )
    joined = O.with_carry(segmented, carry)
    back = O.cells(by, order).rowsBetween(W.unboundedPreceding, 0)
    ahead = O.cells(by, order, descending=True).rowsBetween(W.unboundedPreceding, -1)
    found = joined.withColumn(
        "prev", F.last(F.coalesce("_frame", "_earlier"), ignorenulls=True).over(back)
    ).withColumn("next", F.last(F.coalesce("_frame", "_later"), ignorenulls=True).over(ahead))
    kept = O.only_rows(found, "_earlier", "_later").filter(F.col("_probe") == 1)
    return kept.select(*by, "_asked.*", "prev", "next")


def interpolate_at(
    probes: DataFrame,
    keyframes: DataFrame,
    by: Sequence[str],
    blended: Sequence[str] = BLENDED,
    switched: Sequence[str] = SWITCHED,
    faded: Sequence[str] = ("viseme_weight",),
    defaults: Mapping[str, object] | None = None,
    fade: float = FADE,
    t: str = "t",
    seq: str = "seq",
    probe_time: str = "now",
) -> DataFrame:
    """State of each timeline at each probe.

    Between two keyframes numbers blend on a smooth step and categories switch past its
    middle.  After the last keyframe its state holds, the ``faded`` fields running out over
    ``fade`` seconds; before the first one the defaults apply (0 for numbers, else null).
    """
    kept = keyframes.select(*by, t, seq, *blended, *switched)
    at = asof_bracket(probes, kept, by, t, seq, probe_time)
    now, a, b = F.col(probe_time).cast("double"), F.col("prev"), F.col("next")
    span = b[t].cast("double") - a[t].cast("double")
    f = F.when(span <= 0, 1.0).otherwise(smoothstep((now - a[t].cast("double")) / span))
    timed = at.withColumn("_f", f)
    left = F.greatest(F.lit(0.0), F.lit(1.0) - (now - a[t].cast("double")) / fade)
    known = defaults or {}
    columns = []
    for name in blended:
        held = a[name] * left if name in faded else a[name]
        moving = lerp(a[name], b[name], F.col("_f"))
        value = F.when(a.isNotNull() & b.isNotNull(), moving).when(a.isNotNull(), held)
        columns.append(value.otherwise(F.lit(float(known.get(name, 0.0)))).alias(name))
    for name in switched:
        moving = F.when(F.col("_f") > 0.5, b[name]).otherwise(a[name])
        value = F.when(a.isNotNull() & b.isNotNull(), moving).when(a.isNotNull(), a[name])
        columns.append(value.otherwise(F.lit(known.get(name))).alias(name))
    names = [c for c in at.columns if c not in ("prev", "next")]
    return timed.select(*names, *columns)


def _frame(t: Column, index: Column | int, weight: float) -> Column:
    index = F.lit(index) if isinstance(index, int) else index
    return F.struct(
        t.alias("t"), index.cast("int").alias("viseme_index"), F.lit(float(weight)).alias("viseme_weight")
    )


def _heard(group: Column, start: Column, end: Column) -> Column:
    return F.when((group == 0) | (end - start < SHORTEST), 0).otherwise(group)


def alignment_keyframes(
    rows: DataFrame,
    by: Sequence[str],
    pos: str = "pos",
    symbol: str = "symbol",
    start: str = "start",
    end: str = "end",
    offset: float = 0.0,
    groups: Column | None = None,
) -> DataFrame:
    """Alignment rows to keyframes (by, t, pos, step, viseme_index, viseme_weight).

    A silent or very short row gives a rest when the row before was not one; any other
    row gives an onset when its group is new, a peak, an end and a release.  A final rest
    follows the last row.  Read in (t, pos, step) order.

    Rows that bring the row ``before`` them along, as ``read_alignments`` gives them, are taken as they are;
    only those marked ``shared`` and rows of other sources are put in order.
    """
    by = list(by)
    group = symbol_of(F.col(symbol)) if groups is None else groups
    s, e = F.col(start).cast("double"), F.col(end).cast("double")
    heard = _heard(group, s, e)
    carried = groups is None and {"before", "shared"} <= set(rows.columns)
    base = rows.select(*by, F.col(pos).alias("pos"), s.alias("_s"), e.alias("_e"), heard.alias("_group"),
                       *(["last_end"] if "last_end" in rows.columns else []), *(["before", "shared"] if carried else []))
    placed = base.filter(F.col("pos").isNotNull())
    if carried:
        b = F.col("before")
        told = _heard(symbol_of(b["symbol"]), b["start"].cast("double"), b["end"].cast("double"))
        seen = placed.filter(~F.col("shared")).withColumn("_before", F.when(b.isNotNull(), told)).unionByName(
            O.previous_value(placed.filter("shared"), "_group", ["pos"], by, "_before")
        )
    else:
        seen = O.previous_value(placed, "_group", ["pos"], by, "_before")
    before, g = F.coalesce("_before", F.lit(-1)), F.col("_group")
    rest = F.when((g == 0) & (before != 0), _frame(F.col("_s"), 0, 0.0))
    onset = F.when((g != 0) & (before != g), _frame(F.col("_s"), g, 0.0))
    spoken = [
        F.when(g != 0, _frame((F.col("_s") + F.col("_e")) / 2, g, 1.0)),
        F.when(g != 0, _frame(F.col("_e"), g, 0.8)),
        F.when(g != 0, _frame(F.col("_e") + RELEASE, 0, 0.0)),
    ]
    frames = F.filter(F.array(rest, onset, *spoken), lambda x: x.isNotNull())
    body = seen.select(*by, "pos", F.posexplode(frames).alias("step", "_k"))
    last = F.max("last_end") if "last_end" in base.columns else F.max_by("_e", "pos")
    closing = base.groupBy(*by).agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("pos"), last.alias("_e")).select(
        *by, "pos", F.lit(0).alias("step"), _frame(F.col("_e") + FINAL_REST, 0, 0.0).alias("_k")
    )
    return body.unionByName(closing).select(
        *by, (F.col("_k.t") + offset).alias("t"), "pos", "step", "_k.viseme_index", "_k.viseme_weight"
    )


def playable(frames: DataFrame, emotion: str = "neutral") -> DataFrame:
    """Built keyframes with every field that :func:`interpolate_at` reads: a tie-break, a plain emotion, a still head."""
    seq = F.col("seq") if "seq" in frames.columns else F.col("pos").cast("bigint") * 8 + F.col("step")
    still = {c: F.lit(0.0) for c in ("emotion_blend", "head_yaw", "head_pitch", "head_roll")}
    fields = {"seq": seq.cast("bigint"), "emotion_a": F.lit(emotion), "emotion_b": F.lit(emotion), **still}
    return frames.withColumns({name: value for name, value in fields.items() if name == "seq" or name not in frames.columns})


def symbol_schedule(texts: DataFrame, by: Sequence[str], text: str = "text", start_offset: float = 0.3) -> DataFrame:
    """Paced keyframes of a text: four per symbol, a gap per word, a closing rest.

    The clock of a symbol depends only on how many symbols and words come before it in its
    own text, so each row is scheduled where it is: no shuffle, no window.
    """
    by = list(by)
    per_word = F.transform(
        words_of(F.col(text)),
        lambda word, i: F.transform(symbols_of(word), lambda code: F.struct(i.alias("word"), code.cast("int").alias("code"))),
    )
    flat = texts.select(
        *by, F.inline(F.array(F.struct(F.size(words_of(F.col(text))).alias("_words"), F.flatten(per_word).alias("_symbols"))))
    )
    step = RAMP + HOLD + RAMP
    moments = ((0.0, 0.0), (RAMP, 0.85), (RAMP + HOLD, 0.85), (step, 0.0))

    def frames(symbol: Column, k: Column) -> Column:
        t = F.lit(start_offset) + k * step + symbol.word * WORD_GAP
        return F.array(*[_frame(t + after, symbol.code, weight) for after, weight in moments])

    clock_end = F.lit(start_offset) + F.size("_symbols") * step + F.col("_words") * WORD_GAP
    closing = F.array(_frame(clock_end + FINAL_REST, 0, 0.0))
    all_frames = F.concat(F.flatten(F.transform("_symbols", frames)), closing)
    return flat.select(*by, F.posexplode(all_frames).alias("seq", "_k")).select(*by, "seq", "_k.*")


def moving_rate(df: DataFrame, by: Sequence[str], t: str, tie: Sequence[str], n: int = 30) -> DataFrame:
    """Add ``rate``: (k - 1) / (t - first t) over the last n rows up to each row, 0 when undefined.

    A cell takes the last n - 1 times of the cells before it along in its carry row.
    """
    by = list(by)
    order = [t, *tie]
    segmented = O.with_segment(df, order)
    newest = W.partitionBy(*by, O.SEGMENT).orderBy(*[F.col(c).desc() for c in order])
    tails = (
        segmented.select(*by, O.SEGMENT, *dict.fromkeys(order))
        .withColumn("_back", F.row_number().over(newest))
        .filter(F.col("_back") < n)
        .groupBy(*by, O.SEGMENT)
        .agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_tail"))
    )
    # Every cell holds at least one row, so the n - 1 cells before hold all that is needed.
    before = W.partitionBy(*(by or [F.lit(0)])).orderBy(O.SEGMENT).rowsBetween(-(n - 1), -1)
    gathered = tails.withColumn("_all", F.flatten(F.collect_list("_tail").over(before)))
    newest_first = F.greatest(F.size("_all") - (n - 2), F.lit(1))
    carry = gathered.select(
        *by, O.SEGMENT, F.transform(F.slice("_all", newest_first, n - 1), lambda x: x[t]).alias("_earlier")
    )
    w = O.cells(by, order)
    joined = O.with_carry(segmented, carry)
    number = F.row_number().over(w) - 1
    earlier = F.first("_earlier").over(w)
    placed = joined.withColumn("_i", number).withColumn("_earlier", earlier).withColumn(
        "_head", F.first(F.when(F.col(O.IS_ROW) == 1, F.col(t)), ignorenulls=True).over(w)
    ).withColumn("_lag", F.lag(t, n - 1).over(w))
    rows = O.only_rows(placed)
    borrowed = F.least(F.size("_earlier"), F.greatest(F.lit(n) - F.col("_i"), F.lit(0)))
    k = F.least(F.col("_i"), F.lit(n)) + borrowed
    first = F.when(F.col("_i") >= n, F.col("_lag")).when(
        borrowed > 0, F.element_at("_earlier", F.greatest(F.size("_earlier") - borrowed + 1, F.lit(1)).cast("int"))
    ).otherwise(F.col("_head"))
    span = F.col(t).cast("double") - first.cast("double")
    rate = F.when((k >= 2) & (span > 0), (k - 1) / span).otherwise(0.0)
    return rows.withColumn("rate", rate).drop("_i", "_earlier", "_head", "_lag")


def merge_timeline(old: DataFrame, new: DataFrame, cut: Column | float, t: str = "t") -> DataFrame:
    """Rows of the old timeline before the cut, then the new timeline."""
    return old.filter(F.col(t) < cut).unionByName(new, allowMissingColumns=True)


def append_transition(timeline: DataFrame, transition: DataFrame) -> DataFrame:
    """Add transition keyframes; readers order by (t, seq), so no sort is needed here."""
    return timeline.unionByName(transition, allowMissingColumns=True)


def prune_timeline(
    timeline: DataFrame, now: Column | float, by: Sequence[str], t: str = "t", seq: str = "seq", keep: float = STALE_AFTER
) -> DataFrame:
    """Drop keyframes older than ``keep`` seconds except the newest of them.

    A timeline of at most four keyframes, or with at most one stale one, stays as it is.
    """
    by = list(by)
    place = F.struct(t, seq)
    stale = F.col(t).cast("double") < (now if isinstance(now, Column) else F.lit(float(now))) - keep
    limits = timeline.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(stale).alias("_stale"), F.max(F.when(stale, place)).alias("_from")
    )
    cut = limits.filter((F.col("_n") > 4) & (F.col("_stale") > 1)).select(*by, "_from")
    return timeline.join(cut, by, "left").filter(F.col("_from").isNull() | (place >= F.col("_from"))).drop("_from")
