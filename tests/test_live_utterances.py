"""Live utterances: timers close them, endless ones come in parts, stream equals batch, nothing is lost."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkaudit.operators.transcripts import utterances
from sparkaudit.streaming.utterances import start_utterances, wait_for_fragments

SCHEMA = "call_id string, ts timestamp, text string"
AT = datetime(2024, 1, 1)
NAMES = ["call_id", "start", "end", "part", "fragments", "text", "final"]


def at(seconds):
    return AT + timedelta(seconds=seconds)


def plain(fragments, gap, per_part):
    """Utterance parts by a plain loop."""
    out, calls = set(), {}
    for call, ts, text in sorted((f for f in fragments if f[1]), key=lambda f: (f[1], f[2] is not None, f[2] or "")):
        said = calls.setdefault(call, [])
        if said and (ts - said[-1][-1][0]).total_seconds() < gap:
            said[-1].append((ts, text))
        else:
            said.append([(ts, text)])
    for call, said in calls.items():
        for u in said:
            for k in range(0, len(u), per_part):
                part = u[k : k + per_part]
                text = " ".join(t for _, t in part if t is not None)
                out.add((call, u[0][0], part[-1][0], k // per_part, len(part), text, k + per_part >= len(u)))
    return out


def rows_of(df):
    return {tuple(r[c] for c in NAMES) for r in df.collect()}


def land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, **options):
    return spark.readStream.schema(SCHEMA).options(**options).parquet(path)


FIRST = [("a", at(0), "one"), ("a", at(1), "two"), ("a", at(5), "three"), ("idle", at(0), "hello"), (None, at(3), "x"), ("a", None, "never")]
SECOND = [("a", at(4.5), "early"), ("a", at(60), "four"), ("endless", at(0), None)] + [("endless", at(i / 2), f"w{i:03d}") for i in range(50)]


@pytest.mark.parametrize("per_part", [7, 1000])
def test_batch(spark, many_segments, per_part):
    rows = FIRST + SECOND + [("hot", at(i % 97 * 3), f"t{i}") for i in range(300)]
    got = rows_of(utterances(spark.createDataFrame(rows, SCHEMA), 2.0, per_part))
    assert got == plain(rows, 2.0, per_part)


def test_stream_equals_batch(spark, scratch):
    land(spark, f"{scratch}/in", FIRST)
    land(spark, f"{scratch}/in", SECOND)
    query = start_utterances(
        stream(spark, f"{scratch}/in", maxFilesPerTrigger=1), f"{scratch}/out", f"{scratch}/ck", "0 seconds",
        idle=timedelta(seconds=4), per_part=7, lateness=timedelta(seconds=10),
    )
    n = sum(1 for r in FIRST + SECOND if r[1])
    wait_for_fragments(spark, query, f"{scratch}/out", n, 120)
    out = spark.read.parquet(f"{scratch}/out")
    assert out.filter("late").count() == 0
    assert rows_of(out) == plain(FIRST + SECOND, 2.0, 7)
    assert out.filter("call_id = 'endless'").count() == 8 and out.filter("call_id = 'endless' and final").count() == 1


def test_late_and_crowded_fragments_are_kept(spark, scratch):
    land(spark, f"{scratch}/in", [("a", at(100), "new"), ("b", at(0), "only")])
    query = start_utterances(
        stream(spark, f"{scratch}/in"), f"{scratch}/out", f"{scratch}/ck", "0 seconds",
        idle=timedelta(seconds=1), lateness=timedelta(seconds=5), per_part=4, most=10,
    )
    wait_for_fragments(spark, query, f"{scratch}/out", 2, 120)
    # The call was closed by its timer; what is older than its place now is late, what is newer opens another utterance.
    land(spark, f"{scratch}/in", [("a", at(50), "late"), ("a", at(101), "again")] + [("c", at(i), f"{i:02d}") for i in range(40)])
    query = start_utterances(
        stream(spark, f"{scratch}/in"), f"{scratch}/out", f"{scratch}/ck", "0 seconds",
        idle=timedelta(seconds=1), lateness=timedelta(seconds=5), per_part=4, most=10,
    )
    wait_for_fragments(spark, query, f"{scratch}/out", 44, 120)
    out = spark.read.parquet(f"{scratch}/out")
    assert [(r["call_id"], r["text"]) for r in out.filter("late and call_id = 'a'").collect()] == [("a", "late")]
    assert {r["text"] for r in out.filter("call_id = 'a' and not late").collect()} == {"new", "again"}
    crowded = out.filter("call_id = 'c'")
    assert crowded.agg(F.sum("fragments")).first()[0] == 40
    assert " ".join(r["text"] for r in crowded.orderBy("end").collect()) == " ".join(f"{i:02d}" for i in range(40))
