import json
import os

from pyspark.sql import functions as F

from sparkaudit.operators import audit as A
from sparkaudit.sinks.lattices import write_manifests
from sparkaudit.sources.lattices import MANIFEST
from sparkaudit.sources.media import read_probe_payloads
from sparkaudit.streaming.audit import graded_store, start_audit, stored_files
from sparkaudit.streaming.calls import stream_transcripts, stream_utterances
from sparkaudit.streaming.manifests import stream_manifests

TURNS = "conv_id string, turn int, role string, text string, ts timestamp"


def run(stream, spark, scratch, name):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", f"{scratch}/ck_{name}").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.table(name).collect()


def land(spark, rows, schema, path):
    df = spark.createDataFrame(rows, schema)
    df = df.withColumn("ts", F.to_timestamp("ts")) if "ts string" in schema else df
    df.coalesce(1).write.mode("append").parquet(path)
    return df


def test_transcripts_emit_ended_calls(spark, scratch):
    schema = TURNS.replace("ts timestamp", "ts string")
    first = [("a", 1, "user", "hi", "2024-01-01 00:01:00"), ("a", 0, "bot", "hello", "2024-01-01 00:00:00"),
             ("b", 0, "bot", "yo", "2024-01-01 00:05:00")]
    land(spark, first, schema, f"{scratch}/in")
    land(spark, [("flush", 0, "x", "x", "2024-01-02 00:00:00")], schema, f"{scratch}/in")
    typed = spark.read.parquet(f"{scratch}/in").schema
    stream = spark.readStream.schema(typed).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    rows = run(stream_transcripts(stream), spark, scratch, "calls")
    got = {r["conv_id"]: (r["turns"], r["transcript"]) for r in rows}
    assert got == {"a": (2, "bot: hello\nuser: hi"), "b": (1, "bot: yo")}
    batch = stream_transcripts(spark.read.parquet(f"{scratch}/in")).filter("conv_id <> 'flush'").collect()
    assert sorted(map(str, batch)) == sorted(map(str, rows))


def test_utterances_cut_at_silence(spark, scratch):
    schema = "call_id string, ts string, text string"
    rows = [("a", f"2024-01-01 00:00:0{s}", t) for s, t in ((0, "one"), (1, "two"), (5, "three"))]
    land(spark, rows, schema, f"{scratch}/in")
    land(spark, [("z", "2024-01-01 01:00:00", "end")], schema, f"{scratch}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{scratch}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    got = run(stream_utterances(stream), spark, scratch, "said")
    assert sorted(r["text"] for r in got) == ["one two", "three"] or sorted(r["text"] for r in got) == ["one two", "three"][::-1]


def test_manifests_once_per_run(spark, scratch):
    actions = [("f1", "patch", "m1"), ("f2", "patch", "m2")]
    rows = [(1775595414, 1, "aa", 7.5, 0.0, actions), (1775595999, 2, "bb", 7.6, 0.0, [])]
    df = spark.createDataFrame(rows, MANIFEST)
    write_manifests(df, f"{scratch}/in")
    write_manifests(df, f"{scratch}/in")
    got = run(stream_manifests(spark, f"{scratch}/in"), spark, scratch, "runs")
    assert sorted((r["timestamp"], r["file"]) for r in got if r["file"]) == [(1775595414, "f1"), (1775595414, "f2")]
    assert len(got) == 3


def probe(path, rate, size=1):
    video = {"codec_type": "video", "codec_name": "h264", "width": 10, "height": 10}
    return path, json.dumps({"format": {"duration": "5", "bit_rate": str(rate)}, "streams": [video]}), size


def test_audit_store_equals_batch(spark, scratch):
    schema = "path string, payload string, size_bytes bigint"
    first = [probe(f"/f{i}", 100 + i) for i in range(6)] + [("/bad", None, 1)]
    second = [probe("/f0", 900), probe("/f9", 50)]
    land(spark, first, schema, f"{scratch}/in")
    source = lambda: spark.readStream.schema(schema).parquet(f"{scratch}/in")
    start_audit(source(), f"{scratch}/store", f"{scratch}/ck").awaitTermination()
    land(spark, second, schema, f"{scratch}/in")
    start_audit(source(), f"{scratch}/store", f"{scratch}/ck").awaitTermination()
    streams = os.listdir(f"{scratch}/store")
    assert len(streams) == 1 and sorted(os.listdir(f"{scratch}/store/{streams[0]}"))[-2:] == ["batch=0", "batch=1"]
    now = spark.createDataFrame(second + first[1:], schema)
    want = A.percentile_grade(A.with_verdict(read_probe_payloads(now)).filter("not corrupt"))
    assert stored_files(spark, f"{scratch}/store").count() == 8
    # A new checkpoint counts its batches anew, beside those already stored.
    start_audit(source(), f"{scratch}/store", f"{scratch}/other").awaitTermination()
    assert len(os.listdir(f"{scratch}/store")) == 2 and stored_files(spark, f"{scratch}/store").count() == 8
    pick = ["path", "percentile", "grade"]
    assert sorted(map(str, graded_store(spark, f"{scratch}/store").select(*pick).collect())) == sorted(
        map(str, want.select(*pick).collect()))
