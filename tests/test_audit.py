import json
import math

from pyspark.sql import functions as F

from sparkaudit.operators import audit as A
from sparkaudit.plans.audit import audit_probes, audit_report
from sparkaudit.sinks.audit import audit_text_lines
from sparkaudit.sources.media import read_probe_payloads, read_vmaf_logs, scan_media_files

VIDEO = {"codec_type": "video", "codec_name": "hevc", "width": 1920, "height": "1080", "r_frame_rate": "24000/1001"}


def payload(duration="100", rate="5000000", streams=(VIDEO,), **fmt):
    return json.dumps({"format": {"duration": duration, "bit_rate": rate, **fmt}, "streams": list(streams)})


PROBES = [
    ("/m/a.mkv", payload(), 10),
    ("/m/b.mkv", None, 20),
    ("/m/c.mkv", "{bad", 30),
    ("/m/d.mkv", payload(streams=[{"codec_type": "audio", "codec_name": "aac"}]), 40),
    ("/m/e.mkv", payload(duration="0"), 50),
    ("/m/f.mkv", payload(streams=[{**VIDEO, "width": 0}]), 60),
    ("/m/g.mkv", payload(rate=None, streams=[{**VIDEO, "bit_rate": "750"}, {"codec_type": "audio"}], format_name="mkv"), 70),
    ("/m/h.mkv", payload(rate="N/A"), 80),
    ("/m/i.mkv", "  ", 90),
    ("/m/j.mkv", payload(duration="nan", streams=[{**VIDEO, "codec_name": "zzz", "r_frame_rate": "0/0"}]), 100),
]
SCHEMA = "path string, payload string, size_bytes bigint"


def test_verdict_order_and_neutral_scores(spark):
    rows = {r["path"][3]: r for r in A.with_verdict(read_probe_payloads(spark.createDataFrame(PROBES, SCHEMA))).collect()}
    reasons = {k: r["corrupt_reason"] for k, r in rows.items()}
    assert reasons == {
        "a": "", "b": "ffprobe failed to read file", "c": "ffprobe failed to read file", "d": "no video stream found",
        "e": "duration is zero or missing", "f": "zero-dimension video stream", "g": "", "h": "",
        "i": "ffprobe failed to read file", "j": "",
    }
    assert rows["a"]["norm_efficiency"] == 5000000 / (1920 * 1080) / 1.8
    assert rows["g"]["bitrate_bps"] == 750.0 and rows["g"]["audio_codecs"] == [""] and rows["g"]["format_name"] == "mkv"
    assert math.isinf(rows["h"]["norm_efficiency"]) and rows["j"]["codec_factor"] == 0.8 and rows["j"]["fps"] == 0.0
    assert (rows["e"]["codec_factor"], rows["e"]["norm_efficiency"]) == (1.0, 0.0)


def graded(spark, scores):
    df = spark.createDataFrame([(f"/f{i:03d}", s) for i, s in enumerate(scores)], "path string, norm_efficiency double")
    return [(r["percentile"], r["grade"]) for r in A.percentile_grade(df).orderBy("path").collect()]


def test_grades_of_small_and_infinite_sets(spark):
    inf = math.inf
    assert graded(spark, [inf, inf]) == [(100.0, "?")] * 2
    assert graded(spark, [inf, 3.0]) == [(100.0, "?"), (50.0, "?")]
    assert graded(spark, [4.0, 1.0, inf, 2.0, 3.0, 5.0]) == [
        (4 / 5 * 100, "poor"), (1 / 5 * 100, "excellent"), (100.0, "?"), (2 / 5 * 100, "good"),
        (3 / 5 * 100, "fair"), (100.0, "terrible")]


def test_grades_do_not_depend_on_segments(spark, many_segments):
    scores = [float(i * 7919 % 211) for i in range(400)] + [math.inf] * 40 + [5.0] * 200
    cut = graded(spark, scores)
    spark.conf.unset("spark.sparkaudit.rowsPerSegment")
    assert cut == graded(spark, scores)


def test_decode_samples(spark):
    files = A.with_verdict(read_probe_payloads(spark.createDataFrame(PROBES, SCHEMA)))
    samples = spark.createDataFrame(
        [("/m/a.mkv", 0.9, 1, False, None), ("/m/a.mkv", 0.5, 1, False, None), ("/m/b.mkv", 0.1, 1, False, None),
         ("/m/g.mkv", 0.1, 0, True, None), ("/m/h.mkv", 0.1, 0, False, "gone"), ("/m/j.mkv", 0.1, 0, False, None)],
        "path string, frac double, exit_code int, timed_out boolean, error string")
    got = {r["path"][3]: r["corrupt_reason"] for r in A.apply_decode_samples(files, samples).collect()}
    assert got["a"] == "frame decode failed at 50% (50.0s)" and got["g"] == "decode timed out at 10%"
    assert got["h"] == "ffmpeg error: gone" and got["b"] == "ffprobe failed to read file" and got["j"] == ""


def test_quality_join_and_logs(spark):
    logs = spark.createDataFrame(
        [("/m/a.mkv", '{"pooled_metrics":{"vmaf":{"mean":"91.5"}}}'), ("/m/g.mkv", '{"pooled_metrics":{}}'), ("/m/h.mkv", "x")],
        "path string, payload string")
    assert [r[0] for r in read_vmaf_logs(logs).orderBy("path").select("vmaf_mean").collect()] == [91.5, None, None]
    out = audit_probes(spark.createDataFrame(PROBES, SCHEMA), vmaf_logs=logs, reference="/m/h.mkv")
    got = {r["path"][3]: r["vmaf_mean"] for r in out.collect()}
    assert got["a"] == 91.5 and got["h"] == 100.0 and got["g"] is None and got["b"] is None


def test_sorting_puts_unknowns_last_and_turns_whole(spark):
    df = spark.createDataFrame([("/b", 1.0, None), ("/a", math.inf, 80.0), ("/c", 2.0, 90.0)],
                               "path string, norm_efficiency double, vmaf_mean double")
    order = lambda *a: "".join(r["path"][1] for r in A.sort_report(df, *a).collect())
    assert (order("efficiency"), order("efficiency", True)) == ("bca", "acb")
    assert (order("vmaf"), order("vmaf", True)) == ("cab", "bac")


def test_reports_on_disk(spark, scratch):
    audited = audit_probes(spark.createDataFrame(PROBES, SCHEMA))
    summary = audit_report(audited, scratch, "size", True).first()
    assert (summary["scanned"], summary["valid"], summary["corrupt"], summary["any_corrupt"]) == (10, 4, 6, True)
    rows = spark.read.option("header", True).csv(f"{scratch}/csv").collect()
    assert len(rows) == 10 and len(rows[0]) == 24
    assert {r["path"]: r["norm_efficiency"] for r in rows}["/m/h.mkv"] == "N/A"
    lines = [r[0] for r in spark.read.text(f"{scratch}/text").collect()]
    assert "Valid files (4) — sorted by size (desc)" in lines and "CORRUPT / UNREADABLE FILES (6)" in lines
    assert sum(line.startswith("  [CORRUPT] ") for line in lines) == 6


def test_file_listing_is_complete(spark):
    names = ["a.mkv", "b.TXT", "c.MP4", "._a.mkv", "_b.mkv", ".c.mkv", "zero.mkv", "deep/d.mkv"]
    rows = [(f"/m/{n}", 0 if "zero" in n else 4) for n in names] + [("/mm/x.mkv", 4)]
    manifest = spark.createDataFrame(rows, "path string, size_bytes bigint")
    listed = {r["path"][3:]: r["size_bytes"] for r in scan_media_files(manifest, "/m").collect()}
    assert listed == {"a.mkv": 4, "c.MP4": 4, "_b.mkv": 4, ".c.mkv": 4, "zero.mkv": 0, "deep/d.mkv": 4}
    assert scan_media_files(manifest, "/m/", recursive=False).count() == 5
    assert A.filter_report(scan_media_files(manifest, "/m"), "path", "C.mp4").count() == 1


def test_csv_keeps_blanks_and_quotes(spark, scratch):
    from sparkaudit.sinks.audit import CSV

    text = '  Lead "Q", show '
    spark.createDataFrame([(text, "")], "a string, b string").coalesce(1).write.options(**CSV).csv(f"{scratch}/q")
    import csv
    import glob

    lines = list(csv.reader(open(glob.glob(f"{scratch}/q/part-*.csv")[0], newline="")))
    assert lines == [["a", "b"], [text, ""]]


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_places_of_equals_that_lie_in_many_cells(spark, many_segments):
    rows = [
        (f"/l/{p}{i % 70}/{i}", i % 3, float(i % 2) if i % 5 else None, "c" if i % 9 else None, math.nan if i % 31 == 0 else -0.0 if i % 2 else 0.0)
        for i in range(150) for p in ("a", "a\x01", "a b", "\x00")
    ] + [(None, None, None, None, None)]
    schema = "path string, size_bytes bigint, vmaf_mean double, codec string, fps double"
    df = spark.createDataFrame(rows, schema)
    keys = ("size", "vmaf", "codec", "fps", "name")
    out = A.report_places(df, keys)
    got = {(r["sort_key"], r["turned"], r["place"]): r["path"] for r in out.collect()}
    for key in keys:
        for turned in (False, True):
            wanted = [r["path"] for r in A.sort_report(df, key, turned).collect()]
            if turned:  # of equal keys and null ones: null ones are last then, as the least
                assert [got[key, True, i + 1] for i in range(len(rows))] == wanted, key
            else:
                assert [got[key, False, i + 1] for i in range(len(rows))] == wanted, key
    # One shuffle of the rows: what else is shuffled is one row per cell.
    assert sum("Exchange hashpartitioning" in line and "_path_key" not in line for line in plan_of(out).splitlines()) <= 8
    assert plan_of(out).count("SortMergeJoin") == 0


def test_text_report_is_sorted_before_it_is_formatted(spark):
    probes = spark.createDataFrame([("/m/b.mkv", None, 20), ("/m/b.mkv", "{bad", 30), ("/m/a.mkv", payload(), 10)], SCHEMA)
    lines = audit_text_lines(audit_probes(probes))
    assert "format_string" not in plan_of(lines).split("rangepartitioning")[1]
    values = [r["value"] for r in lines.collect()]
    assert values[0] == "MEDIA AUDIT REPORT" and values[10].endswith("a.mkv") and values[13] == "CORRUPT / UNREADABLE FILES (2)"
    # The lines of a file stay together, also beside those of an equal path.
    assert [v.strip().split(" ")[0] for v in values[15:]] == ["[CORRUPT]", "Reason:", "Size:", ""] * 2
