"""Stored streams: manifests in time or in the dead-letter table, grades by the order index."""

import json

import pytest
from pyspark.sql import functions as F

from sparkaudit.operators import audit as A
from sparkaudit.sinks.lattices import write_manifests
from sparkaudit.sources.lattices import MANIFEST
from sparkaudit.sources.media import read_probe_payloads
from sparkaudit.operators.ordering import cut_points
from sparkaudit.streaming import graded
from sparkaudit.streaming.graded import graded_ranges, merge_batch, read_index, start_graded_audit
from sparkaudit.streaming.manifests import DAY, landed_manifests, start_manifests, stored_manifests

PROBES = "path string, payload string, size_bytes bigint"


def run_manifests(spark, scratch, rows):
    write_manifests(spark.createDataFrame(rows, MANIFEST), f"{scratch}/in")
    start_manifests(landed_manifests(spark, f"{scratch}/in"), f"{scratch}/store", f"{scratch}/ck").awaitTermination()


def test_every_manifest_is_in_one_table(spark, scratch):
    now = 1775595414
    run_manifests(spark, scratch, [(now, 1, "aa", 7.5, 0.0, [("f", "t", "m")]), (now + 5, 2, "bb", 7.5, 0.0, []), (now + 5, 1, "zz", 7.5, 0.0, [])])
    # A copy, one that is late but within the bound, one far too late, and one without a time.
    late = (now - 3 * DAY, 9, "late", 1.0, 0.0, [])
    run_manifests(spark, scratch, [(now, 1, "aa", 7.5, 0.0, []), (now - 100, 3, "cc", 7.5, 0.0, []), late, (None, 4, "none", 0.0, 0.0, [])])
    run_manifests(spark, scratch, [late, (now + 9, 5, "dd", 7.5, 0.0, [])])
    good = [(r["timestamp"], r["matrix_fp"], len(r["actions"])) for r in stored_manifests(spark, f"{scratch}/store").collect()]
    dead = [(r["timestamp"], r["matrix_fp"]) for r in stored_manifests(spark, f"{scratch}/store", late=True).collect()]
    assert sorted(good) == [(now - 100, "cc", 0), (now, "aa", 1), (now + 5, "zz", 0), (now + 9, "dd", 0)]
    assert dead == [(now - 3 * DAY, "late")]


def probe(path, rate):
    video = {"codec_type": "video", "codec_name": "h264", "width": 10, "height": 10}
    return path, json.dumps({"format": {"duration": "5", "bit_rate": str(rate)}, "streams": [video]}), 1


def grades(df):
    return sorted((r["path"], r["norm_efficiency"], r["percentile"], r["grade"]) for r in df.collect())


def batch_grades(spark, rows):
    latest = {}
    for r in rows:
        latest[r[0]] = r
    good = A.with_verdict(read_probe_payloads(spark.createDataFrame(list(latest.values()), PROBES))).filter("not corrupt")
    return grades(A.percentile_grade(good))


def test_grades_follow_from_the_index(spark, scratch, many_segments):
    batches = [
        [probe(f"/f{i:03d}", 100 + i * 37 % 50) for i in range(120)],
        [probe("/f000", 9000), probe("/f001", 0), ("/f002", None, 1), probe("/new", 125)],  # moves, is not measurable, breaks, comes
        [probe(f"/tie{i:03d}", 130) for i in range(90)] + [probe("/f002", 101)],
    ]
    seen, files = [], {}
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, PROBES).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        stream = spark.readStream.schema(PROBES).parquet(f"{scratch}/in")
        start_graded_audit(stream, f"{scratch}/store", f"{scratch}/ck", rows_per_range=25).awaitTermination()
        seen += rows
        assert grades(graded_ranges(spark, f"{scratch}/store")) == batch_grades(spark, seen)
        version, index = read_index(spark, f"{scratch}/store")
        assert version == n + 1 and sum(r["n"] for r in index) == graded_ranges(spark, f"{scratch}/store").count()
        kept = {r["range"] for r in index if files.get(r["range"]) == r["files"]}
        assert n == 0 or kept, "ranges that no row fell into keep their files"
        files = {r["range"]: r["files"] for r in index}


def test_a_batch_that_runs_again_changes_nothing(spark, scratch):
    judged = A.with_verdict(read_probe_payloads(spark.createDataFrame([probe("/a", 5), probe("/b", 7)], PROBES)))
    for _ in range(2):
        merge_batch(judged, f"{scratch}/store", 100, "stream", 0)
    assert read_index(spark, f"{scratch}/store")[0] == 1
    broken = A.with_verdict(read_probe_payloads(spark.createDataFrame([("/a", None, 1)], PROBES)))
    merge_batch(broken, f"{scratch}/store", 100, "stream", 1)
    assert [r["path"] for r in graded_ranges(spark, f"{scratch}/store").collect()] == ["/b"]


@pytest.mark.parametrize("rows", [[], [("/bad", None, 1)]])
def test_no_good_files(spark, scratch, rows):
    judged = A.with_verdict(read_probe_payloads(spark.createDataFrame(rows, PROBES)))
    merge_batch(judged, f"{scratch}/store", 100, "stream", 0)
    assert graded_ranges(spark, f"{scratch}/store") is None or graded_ranges(spark, f"{scratch}/store").count() == 0
    merge_batch(A.with_verdict(read_probe_payloads(spark.createDataFrame([probe("/a", 5)], PROBES))), f"{scratch}/store", 100, "stream", 1)
    assert graded_ranges(spark, f"{scratch}/store").agg(F.count("*")).first()[0] == 1


def test_all_grown_ranges_are_cut_by_one_sample(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(graded, "cut_points", lambda *a: calls.append(a) or cut_points(*a))
    spark.conf.set("spark.sparkaudit.rowsPerSegment", "20")
    try:
        rows = spark.range(400).select((F.col("id") * 7 % 400).cast("double").alias("score"), F.col("id").cast("string").alias("path"))
        lows = [None, (100.0, ""), (200.0, ""), (395.0, "")]
        out = graded.split_bounds(rows, lows, {0, 1, 2, 3}, 20)
    finally:
        spark.conf.unset("spark.sparkaudit.rowsPerSegment")
    assert len(calls) == 1 and [b for b in out if b in lows] == lows and len(out) > 12
    assert out[1:] == sorted(out[1:], key=tuple) and out[-1] == lows[-1]
