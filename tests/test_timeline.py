import json
import random

import pytest
from pyspark.sql import functions as F

from sparkaudit.operators import timeline as K
from sparkaudit.operators.transcripts import assemble_transcripts, gap_sessions
from sparkaudit.sources.timelines import read_alignments

FRAMES = "tl string, t double, seq int, viseme_index int, viseme_weight double, emotion_a string, emotion_b string, emotion_blend double, head_yaw double, head_pitch double, head_roll double"


def frames(rng):
    out = []
    for tl, n in (("hot", 300), ("b", 5), ("c", 1)):
        for i in range(n):
            out.append((tl, rng.randint(0, 400) / 4, i, i % 9, rng.random(), f"e{i % 3}", "n", rng.random(), 0.1, 0.2, rng.random()))
    return out


def expected(keys, now):
    keys = sorted(keys, key=lambda k: (k[1], k[2]))
    prev, nxt = None, None
    for k in keys:
        if k[1] <= now:
            prev = k
        else:
            nxt = k
            break
    if prev is None:
        return 0, 0.0
    if nxt is None:
        return prev[3], prev[4] * max(0.0, 1 - (now - prev[1]) / 0.12)
    x = (now - prev[1]) / (nxt[1] - prev[1])
    f = x * x * (3 - 2 * x)
    return (nxt if f > 0.5 else prev)[3], prev[4] + (nxt[4] - prev[4]) * f


@pytest.mark.parametrize("rows", ["20", "100000"])
def test_interpolation_equals_a_scan(spark, rows):
    spark.conf.set("spark.sparkaudit.rowsPerSegment", rows)
    rng = random.Random(3)
    keys = frames(rng)
    asks = [(tl, rng.randint(-20, 480) / 4, i) for i, tl in enumerate(["hot"] * 200 + ["b"] * 40 + ["c"] * 10 + ["none"] * 3)]
    got = K.interpolate_at(
        spark.createDataFrame(asks, "tl string, now double, id int"), spark.createDataFrame(keys, FRAMES).repartition(6), ["tl"],
        defaults={"viseme_index": 0, "emotion_a": "neutral", "emotion_b": "neutral"}).collect()
    spark.conf.unset("spark.sparkaudit.rowsPerSegment")
    assert len(got) == len(asks)
    for r in got:
        index, weight = expected([k for k in keys if k[0] == r["tl"]], r["now"])
        assert r["viseme_index"] == index and abs(r["viseme_weight"] - weight) < 1e-9


def build(chars, starts, ends, groups):
    out, before = [], -1
    for ch, s, e in zip(chars, starts, ends):
        g = groups.get(ch.lower(), 0)
        if g == 0 or e - s < 0.01:
            if before != 0:
                out.append((s, 0, 0.0))
            before = 0
            continue
        if before != g:
            out.append((s, g, 0.0))
        out += [((s + e) / 2, g, 1.0), (e, g, 0.8), (e + 0.035, 0, 0.0)]
        before = g
    out.append((ends[-1] + 0.3, 0, 0.0))
    return [tuple(round(v, 9) for v in k) for k in sorted(out, key=lambda k: k[0])]


def test_alignment_keyframes(spark, many_segments):
    from sparkaudit.functions.symbols import CHARACTER_GROUPS

    rng = random.Random(8)
    docs, want = [], {}
    for i in range(6):
        n = 1 if i == 0 else 60
        chars = [rng.choice("Hello wörld, thevmb  ") for _ in range(n)]
        starts = [j * 0.1 for j in range(n + (i % 2))]
        ends = [j * 0.1 + rng.choice([0.005, 0.05, 0.1]) for j in range(n)]
        docs.append((i, json.dumps({"alignment": {"characters": chars, "character_start_times_seconds": starts,
                                                   "character_end_times_seconds": ends}})))
        want[i] = build(chars, starts, ends, CHARACTER_GROUPS)
    rows = read_alignments(spark.createDataFrame(docs + [(99, "{}")], "id int, payload string"))
    got = K.alignment_keyframes(rows, ["id"]).orderBy("id", "t", "pos", "step").collect()
    for i, frames_ in want.items():
        assert [tuple(round(v, 9) for v in (r["t"], r["viseme_index"], r["viseme_weight"])) for r in got if r["id"] == i] == frames_


def test_symbol_schedule(spark):
    rows = K.symbol_schedule(spark.createDataFrame([(1, "Hello, x by")], "id int, text string"), ["id"], start_offset=0.0).orderBy("seq").collect()
    # "Hello" has four symbols, "x" none but its gap, "by" two.
    assert len(rows) == 6 * 4 + 1
    assert [r["viseme_index"] for r in rows[::4]] == [2, 8, 8, 4, 5, 3, 0]
    assert abs(rows[16]["t"] - (4 * 0.51 + 2 * 0.15)) < 1e-9 and abs(rows[-1]["t"] - (6 * 0.51 + 3 * 0.15 + 0.3)) < 1e-9


@pytest.mark.parametrize("rows", ["7", "100000"])
def test_moving_rate(spark, rows):
    spark.conf.set("spark.sparkaudit.rowsPerSegment", rows)
    rng = random.Random(5)
    times = sorted(rng.randint(0, 500) / 10 for _ in range(150))
    data = [("hot", t, i) for i, t in enumerate(times)] + [("b", 1.0, 900), ("b", 1.0, 901), ("b", 3.0, 902)]
    df = spark.createDataFrame(data, "g string, t double, id int").repartition(4)
    got = {r["id"]: r["rate"] for r in K.moving_rate(df, ["g"], "t", ["id"], 30).collect()}
    spark.conf.unset("spark.sparkaudit.rowsPerSegment")
    for i in range(150):
        window = times[max(0, i - 29) : i + 1]
        span = window[-1] - window[0]
        want = (len(window) - 1) / span if len(window) > 1 and span > 0 else 0.0
        assert abs(got[i] - want) < 1e-9
    assert (got[900], got[901], got[902]) == (0.0, 0.0, 1.0)


def test_merge_and_prune(spark):
    old = spark.createDataFrame([("a", float(t), t) for t in range(10)], "tl string, t double, seq int")
    new = spark.createDataFrame([("a", 5.5, 100)], old.schema)
    merged = K.merge_timeline(old, new, 5.0)
    assert sorted(r["t"] for r in merged.collect()) == [0, 1, 2, 3, 4, 5.5]
    assert sorted(r["t"] for r in K.prune_timeline(merged, 5.5, ["tl"]).collect()) == [3, 4, 5.5]
    assert K.prune_timeline(merged.filter("t < 4"), 9.0, ["tl"]).count() == 4
    assert K.prune_timeline(merged, 3.0, ["tl"]).count() == 6
    assert K.append_transition(old, new).count() == 11


def test_transcripts_and_sessions(spark, many_segments):
    turns = spark.createDataFrame([("c", i, "user", f"t{i:03d}") for i in range(95)], "conv_id string, turn int, role string, text string")
    parts = assemble_transcripts(turns.repartition(5), per_part=40).orderBy("part").collect()
    assert [r["turns"] for r in parts] == [40, 40, 15]
    assert "\n".join(r["transcript"] for r in parts) == "\n".join(f"user: t{i:03d}" for i in range(95))
    stamps = spark.range(90).select(F.lit("u").alias("u"), "id", F.timestamp_seconds(F.col("id") * 10 + F.floor(F.col("id") / 30) * 100).alias("ts"))
    rows = gap_sessions(stamps, ["u"], "ts", ["id"], 60.0, [F.count(F.lit(1)).alias("n")]).orderBy("session").collect()
    assert [r["n"] for r in rows] == [30, 30, 30]


def test_playable_and_silent_alignments(spark):
    from sparkaudit.operators.timeline import alignment_keyframes, interpolate_at, playable
    from sparkaudit.sources.timelines import read_alignments

    made = '{"alignment":{"characters":["a","b"],"character_start_times_seconds":[0.0,0.5],"character_end_times_seconds":[0.5,1.0]}}'
    none = '{"alignment":{"characters":[],"character_start_times_seconds":[],"character_end_times_seconds":[2.0]}}'
    rows = read_alignments(spark.createDataFrame([(1, made), (2, none), (3, None)], "id int, payload string"))
    frames = playable(alignment_keyframes(rows, ["id"]))
    assert [(r["t"], r["viseme_weight"]) for r in frames.filter("id = 2").collect()] == [(2.3, 0.0)]
    probes = spark.createDataFrame([(1, 0.25), (2, 1.0), (2, 3.0)], "id int, now double")
    state = {(r["id"], r["now"]): r for r in interpolate_at(probes, frames, ["id"]).collect()}
    assert state[1, 0.25]["viseme_weight"] == 1.0 and state[2, 3.0]["emotion_a"] == "neutral" and state[2, 1.0]["head_yaw"] == 0.0


def test_pairs_of_one_payload_need_no_order(spark):
    from sparkaudit.sources.timelines import read_alignments

    def payload(text):
        ends = [i * 0.25 + 0.125 for i in range(len(text))]
        return json.dumps({"alignment": {"characters": list(text), "character_start_times_seconds": [i * 0.25 for i in range(len(text))],
                                         "character_end_times_seconds": ends}})

    docs = spark.createDataFrame([("x", payload("aa b")), ("y", payload("ab")), ("y", payload("ab"))], "id string, payload string")
    rows = read_alignments(docs)
    frames = K.alignment_keyframes(rows, ["id"])
    plain = K.alignment_keyframes(rows.drop("before", "shared"), ["id"])
    key = lambda df: sorted(map(str, df.filter("id = 'x'").collect()))
    assert key(frames) == key(plain) and frames.count() == plain.count()
    alone = K.alignment_keyframes(rows.filter("NOT shared"), ["id"])
    assert "Window" not in alone._jdf.queryExecution().optimizedPlan().toString()
