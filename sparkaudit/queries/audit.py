"""Media audit queries over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkaudit.functions import media as M
from sparkaudit.functions import text as X
from sparkaudit.operators import audit as A
from sparkaudit.operators.ordering import ranked, spread
from sparkaudit.plans.audit import audit_probes
from sparkaudit.queries import table
from sparkaudit.sinks.audit import audit_rows, audit_text_lines
from sparkaudit.sources.media import media_files, read_probe_payloads, read_vmaf_logs

PART_FACTORS = {"economy": 1.8, "standard": 1.0, "promo": 0.4, "large": 2.5, "small": 0.7}


# ---- scored parts -----------------------------------------------------------


def scored_parts(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    return A.with_efficiency(part, "p_retailprice", F.col("p_size"), "p_type", PART_FACTORS)


def graded_parts(spark: SparkSession, d: str) -> DataFrame:
    return A.percentile_grade(scored_parts(spark, d), tie=["p_partkey"])


SCORED_SQL = """
  SELECT p_partkey, p_name, p_type, p_size, p_retailprice, codec_factor,
         CASE WHEN p_size > 0 AND p_retailprice > 0 THEN p_retailprice / p_size
              ELSE 'inf'::DOUBLE END AS raw_efficiency,
         CASE WHEN p_size > 0 AND p_retailprice > 0 THEN p_retailprice / p_size / codec_factor
              ELSE 'inf'::DOUBLE END AS norm_efficiency
  FROM (SELECT p.*, coalesce(f.factor, 0.8::DOUBLE) AS codec_factor
        FROM part p LEFT JOIN (VALUES ('economy', 1.8::DOUBLE), ('standard', 1.0::DOUBLE),
          ('promo', 0.4::DOUBLE), ('large', 2.5::DOUBLE), ('small', 0.7::DOUBLE)) f(codec, factor)
        ON lower(p.p_type) = f.codec)
"""

BANDS_SQL = """CASE WHEN percentile <= 20 THEN 'excellent' WHEN percentile <= 45 THEN 'good'
  WHEN percentile <= 70 THEN 'fair' WHEN percentile <= 88 THEN 'poor' ELSE 'terrible' END"""

GRADED_SQL = f"""
  SELECT *, {BANDS_SQL} AS grade FROM (
    SELECT *, row_number() OVER (ORDER BY norm_efficiency, p_partkey)
              / count(*) OVER ()::DOUBLE * 100.0 AS percentile
    FROM ({SCORED_SQL}))
"""


def norm_efficiency(spark, d):
    return scored_parts(spark, d).select(
        "p_partkey", "codec_factor", F.round("raw_efficiency", 6).alias("raw_efficiency"),
        F.round("norm_efficiency", 6).alias("norm_efficiency"),
    )


def percentile_grade(spark, d):
    return graded_parts(spark, d).select(
        "p_partkey", F.round("norm_efficiency", 6).alias("norm_efficiency"), "percentile", "grade"
    )


def grade_by_group(spark, d):
    supplier = table(spark, d, "supplier").select(
        "s_suppkey", "s_nationkey",
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).otherwise(F.lit(float("inf"))).alias("score"),
    )
    graded = A.percentile_grade(supplier, "score", ["s_suppkey"], partition_by=["s_nationkey"])
    return graded.select("s_suppkey", "s_nationkey", F.round("percentile", 9).alias("percentile"), "grade")


GRADE_BY_GROUP_SQL = f"""
  SELECT s_suppkey, s_nationkey, round(percentile, 9) AS percentile,
         CASE WHEN isinf(score) OR n < 2 THEN '?' ELSE {BANDS_SQL} END AS grade
  FROM (SELECT *, CASE WHEN isinf(score) THEN 100.0::DOUBLE WHEN n < 2 THEN 50.0::DOUBLE
                       ELSE r / n::DOUBLE * 100.0 END AS percentile
        FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY score, s_suppkey) AS r,
                     count(*) FILTER (WHERE NOT isinf(score)) OVER (PARTITION BY s_nationkey) AS n
              FROM (SELECT s_suppkey, s_nationkey,
                           CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 'inf'::DOUBLE END AS score
                    FROM supplier)))
"""


def summary(spark, d):
    files = table(spark, d, "orders").select(
        F.col("o_custkey").alias("size_bytes"), (F.col("o_orderstatus") == "P").alias("corrupt")
    )
    return A.audit_summary(files)


def codec_counts(spark, d):
    return A.codec_counts(table(spark, d, "part"), "p_type")


def grade_counts(spark, d):
    return A.grade_counts(graded_parts(spark, d))


def efficiency_extremes(spark, d):
    ends = A.efficiency_extremes(scored_parts(spark, d), path="p_partkey")
    return ends.select("best_path", "worst_path", *[F.round(c, 6).alias(c) for c in ("mean", "best", "worst")])


def quality_extremes(spark, d):
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    ends = A.quality_extremes(docs.select("doc_id", F.col("quality").cast("double").alias("q")), "q", "doc_id")
    return ends.select("best_path", "worst_path", "best", "worst", F.round("mean", 6).alias("mean"))


# ---- probe payloads made from orders ----------------------------------------

CODECS = ["h264", "HEVC", "av1", "vp9", "mpeg2video", "mystery", "prores", "mjpeg"]


def order_probes(spark: SparkSession, d: str) -> DataFrame:
    """Landed probe payloads, one per order, with every kind of broken file among them."""
    o = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    case = key % 97
    rate = F.col("o_totalprice").cast("string")
    codec = F.element_at(F.array(*[F.lit(c) for c in CODECS]), (cust % 8 + 1).cast("int"))
    video = F.struct(
        F.lit("video").alias("codec_type"),
        codec.alias("codec_name"),
        F.when(case == 4, 0).otherwise(320 + cust % 1600).cast("int").alias("width"),
        (240 + key % 840).cast("string").alias("height"),
        F.when(case == 6, "0/0").otherwise("24000/1001").alias("r_frame_rate"),
        F.when(case == 5, rate).alias("bit_rate"),
    )
    audio = F.struct(
        F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("string").alias("height"),
        F.lit(None).cast("string").alias("r_frame_rate"), F.lit(None).cast("string").alias("bit_rate"),
    )
    text = F.to_json(
        F.struct(
            F.struct(
                (key % 7200).cast("string").alias("duration"),
                F.when(case != 5, rate).alias("bit_rate"),
                F.lit("matroska").alias("format_name"),
            ).alias("format"),
            F.when(case == 3, F.array(audio)).otherwise(F.array(audio, video, video)).alias("streams"),
        )
    )
    return o.select(
        "o_orderkey",
        F.concat_ws("/", F.lit("/lib"), cust.cast("string"), F.concat(key.cast("string"), F.lit(".mkv"))).alias("path"),
        (cust * 1000003).alias("size_bytes"),
        F.when(case == 1, "{bad").when(case == 2, F.lit(None)).otherwise(text).alias("payload"),
    )


CODEC_VALUES = "[" + ", ".join(f"'{c}'" for c in CODECS) + "]"

PROBE_SQL = f"""
  SELECT '/lib/' || o_custkey || '/' || o_orderkey || '.mkv' AS path, o_orderkey,
         o_custkey * 1000003 AS size_bytes, m NOT IN (1, 2) AS has_payload, m NOT IN (1, 2, 3) AS has_video,
         CASE WHEN m IN (1, 2, 3) THEN '' ELSE {CODEC_VALUES}[o_custkey % 8 + 1] END AS codec,
         CASE WHEN m IN (1, 2) THEN '' ELSE 'matroska' END AS format_name,
         CASE WHEN m IN (1, 2, 3, 4) THEN 0 ELSE 320 + o_custkey % 1600 END::INT AS width,
         CASE WHEN m IN (1, 2, 3) THEN 0 ELSE 240 + o_orderkey % 840 END::INT AS height,
         CASE WHEN m IN (1, 2) THEN 0 ELSE o_orderkey % 7200 END::DOUBLE AS duration_s,
         CASE WHEN m IN (1, 2) THEN 0::DOUBLE ELSE o_totalprice END AS bitrate_bps,
         CASE WHEN m IN (1, 2, 3, 6) THEN 0::DOUBLE ELSE 24000.0::DOUBLE / 1001.0::DOUBLE END AS fps,
         CASE WHEN m IN (1, 2) THEN '' ELSE 'aac' END AS audio
  FROM (SELECT *, o_orderkey % 97 AS m FROM orders)
"""

VERDICT_SQL = f"""
  SELECT *, CASE WHEN corrupt THEN 1.0::DOUBLE ELSE f END AS codec_factor,
         CASE WHEN corrupt THEN 0::DOUBLE ELSE bitrate_bps / (width * height) END AS raw_efficiency,
         CASE WHEN corrupt THEN 0::DOUBLE ELSE bitrate_bps / (width * height) / f END AS norm_efficiency
  FROM (SELECT *, corrupt_reason <> '' AS corrupt,
               CASE lower(codec) WHEN 'h264' THEN 1.0 WHEN 'hevc' THEN 1.8 WHEN 'av1' THEN 2.5 WHEN 'vp9' THEN 1.4
                 WHEN 'mpeg2video' THEN 0.4 WHEN 'prores' THEN 0.3 WHEN 'mjpeg' THEN 0.25 ELSE 0.8 END::DOUBLE AS f
        FROM (SELECT *, CASE WHEN NOT has_payload THEN 'ffprobe failed to read file'
                             WHEN NOT has_video THEN 'no video stream found'
                             WHEN duration_s <= 0 THEN 'duration is zero or missing'
                             WHEN width = 0 OR height = 0 THEN 'zero-dimension video stream' ELSE '' END AS corrupt_reason
              FROM ({PROBE_SQL})))
"""

AUDITED_SQL = f"""
  SELECT *, CASE WHEN corrupt THEN '' ELSE {BANDS_SQL} END AS grade FROM (
    SELECT v.*, coalesce(g.percentile, 0::DOUBLE) AS percentile
    FROM ({VERDICT_SQL}) v LEFT JOIN (
      SELECT path, row_number() OVER (ORDER BY norm_efficiency, path) / count(*) OVER ()::DOUBLE * 100.0 AS percentile
      FROM ({VERDICT_SQL}) WHERE NOT corrupt) g USING (path))
"""


def probe_payloads(spark, d):
    probes = read_probe_payloads(order_probes(spark, d))
    return probes.withColumn("audio", F.array_join("audio_codecs", ", ")).drop("audio_codecs")


def verdict(spark, d):
    judged = A.with_verdict(read_probe_payloads(order_probes(spark, d)))
    good, corrupt = A.split_verdict(judged)
    return good.unionByName(corrupt).select(
        "path", "probe_ok", "corrupt", "corrupt_reason", "codec_factor",
        F.round("raw_efficiency", 9).alias("raw_efficiency"), F.round("norm_efficiency", 9).alias("norm_efficiency"),
    )


def media_audit(spark, d):
    audited = audit_probes(order_probes(spark, d))
    return audited.select(
        "path", "size_bytes", "codec", "corrupt", "corrupt_reason", "percentile", "grade",
        F.round("norm_efficiency", 9).alias("norm_efficiency"),
    )


def audit_csv_rows(spark, d):
    audited = audit_probes(order_probes(spark, d))
    rows = audit_rows(audited)
    return rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])


def _fmt_bitrate_sql(c: str) -> str:
    return f"""CASE WHEN {c} <= 0 THEN 'N/A' WHEN {c} >= 1000000 THEN printf('%.1f Mbps', {c} / 1e6)
      WHEN {c} >= 1000 THEN printf('%.0f Kbps', {c} / 1e3) ELSE printf('%.0f bps', {c}) END"""


def _fmt_size_sql(c: str) -> str:
    return f"""CASE WHEN {c} >= 1073741824 THEN printf('%.2f GB', {c} / 1073741824.0::DOUBLE)
      WHEN {c} >= 1048576 THEN printf('%.1f MB', {c} / 1048576.0::DOUBLE)
      ELSE printf('%.0f KB', {c} / 1024.0::DOUBLE) END"""


def _hms_sql(c: str) -> str:
    s = f"floor({c})::BIGINT"
    return f"""CASE WHEN {c} <= 0 THEN 'unknown' ELSE
      printf('%d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60) END"""


AUDIT_CSV_SQL = f"""
  SELECT path, o_orderkey || '.mkv' AS filename, size_bytes::VARCHAR AS size_bytes,
         printf('%.2f', size_bytes / 1048576.0::DOUBLE) AS size_mb, codec, printf('%.2f', codec_factor) AS codec_factor,
         width::VARCHAR AS width, height::VARCHAR AS height,
         CASE WHEN width <> 0 AND height <> 0 THEN width || 'x' || height ELSE 'unknown' END AS resolution,
         printf('%.2f', duration_s) AS duration_s, {_hms_sql('duration_s')} AS duration_hms,
         printf('%.3f', fps) AS fps, printf('%.0f', bitrate_bps) AS bitrate_bps,
         {_fmt_bitrate_sql('bitrate_bps')} AS bitrate_fmt,
         printf('%.4f', raw_efficiency) AS raw_efficiency, printf('%.4f', norm_efficiency) AS norm_efficiency,
         'N/A' AS vmaf_mean, '' AS vmaf_reference, printf('%.1f', percentile) AS percentile, grade, format_name,
         audio AS audio_codecs, CASE WHEN corrupt THEN 'yes' ELSE 'no' END AS corrupt, corrupt_reason
  FROM ({AUDITED_SQL})
"""


def audit_text(spark, d):
    return audit_text_lines(audit_probes(order_probes(spark, d)))


AUDIT_TEXT_SQL = f"""
  WITH r AS ({AUDIT_CSV_SQL}), n AS (SELECT count(*) FILTER (WHERE corrupt = 'no') AS good,
                                            count(*) FILTER (WHERE corrupt = 'yes') AS bad FROM r)
  SELECT unnest(['MEDIA AUDIT REPORT', repeat('=', 100), '',
           'Valid files (' || good || ') — sorted by efficiency (asc)',
           'NormEff = codec-normalised efficiency (H.264 baseline). Lower is more efficient.',
           'Grade   = percentile rank within this library.', '', repeat('-', 100),
           ' NormEff    RawEff    VMAF    Codec   Factor      Grade   Pctile       Size    Resolution     Bitrate   Duration  Filename',
           repeat('-', 100), '', repeat('=', 100), 'CORRUPT / UNREADABLE FILES (' || bad || ')', repeat('-', 100)]) AS value
  FROM n
  UNION ALL
  SELECT concat_ws('  ', repeat(' ', greatest(0, 8 - length(norm_efficiency))) || norm_efficiency,
           repeat(' ', greatest(0, 8 - length(raw_efficiency))) || raw_efficiency,
           repeat(' ', greatest(0, 6 - length(vmaf_mean))) || vmaf_mean,
           codec || repeat(' ', greatest(0, 7 - length(codec))),
           repeat(' ', greatest(0, 7 - length(codec_factor))) || codec_factor,
           grade || repeat(' ', greatest(0, 9 - length(grade))),
           repeat(' ', greatest(0, 6 - length(percentile))) || percentile || '%',
           repeat(' ', greatest(0, 6 - length(size_mb))) || size_mb || ' MB',
           resolution || repeat(' ', greatest(0, 12 - length(resolution))),
           repeat(' ', greatest(0, 10 - length(bitrate_fmt))) || bitrate_fmt,
           repeat(' ', greatest(0, 9 - length(duration_hms))) || duration_hms, filename)
  FROM r WHERE corrupt = 'no'
  UNION ALL
  SELECT unnest(['  [CORRUPT] ' || path, '            Reason: ' || corrupt_reason,
           '            Size:   ' || {_fmt_size_sql('size_bytes::BIGINT')}, '']) FROM r WHERE corrupt = 'yes'
"""


def vmaf_logs(spark, d):
    e = table(spark, d, "events").select("event_id", "value", "event_type")
    mean = (
        F.when(F.col("event_type") == "error", '"broken"')
        .when(F.col("event_type") == "view", F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"')))
        .otherwise(F.col("value").cast("string"))
    )
    log = F.concat(F.lit('{"pooled_metrics":{"vmaf":{"mean":'), mean, F.lit("}}}"))
    empty = F.lit('{"pooled_metrics":{}}')
    landed = e.select(
        F.col("event_id").cast("string").alias("path"),
        F.when(F.col("event_type") == "signup", empty).otherwise(log).alias("payload"),
    )
    return read_vmaf_logs(landed)


def media_names(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    suffix = F.array(*[F.lit(s) for s in (".mkv", ".MP4", ".txt", ".dvr-ms", "", ".", ".m2ts", ".mkv.part")])
    prefix = F.array(*[F.lit(s) for s in ("", "._", ".", "_", "x.")])
    name = F.concat(
        F.element_at(prefix, (F.col("o_custkey") % 5 + 1).cast("int")),
        F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.col("o_orderkey").cast("string")),
        F.element_at(suffix, (F.col("o_orderkey") % 8 + 1).cast("int")),
    )
    return media_files(o.select(F.concat(F.lit("/lib/"), name).alias("path")))


MEDIA_NAMES_SQL = r"""
  SELECT '/lib/' || name AS path FROM (
    SELECT ['', '._', '.', '_', 'x.'][o_custkey % 5 + 1]
           || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderkey::VARCHAR END
           || ['.mkv', '.MP4', '.txt', '.dvr-ms', '', '.', '.m2ts', '.mkv.part'][o_orderkey % 8 + 1] AS name
    FROM orders)
  WHERE NOT starts_with(name, '._') AND regexp_matches(lower(name), '.\.(mkv|mp4|dvr-ms|m2ts)$')
"""


def decode_samples(spark, d):
    """Files are users, decode samples are their events."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    files = e.groupBy(F.col("user_id").cast("string").alias("path")).agg(F.max("event_id").alias("m")).select(
        "path", (F.col("m") * 0.5).alias("duration_s"), (F.col("m") % 5 != 0).alias("probe_ok"),
        (F.col("m") % 7 == 0).alias("corrupt"),
        F.when(F.col("m") % 7 == 0, "no video stream found").otherwise("").alias("corrupt_reason"),
    )
    samples = e.select(
        F.col("user_id").cast("string").alias("path"),
        ((F.col("event_id") % 100000 + 1) / 200000.0).alias("frac"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 90), 1).otherwise(0).alias("exit_code"),
        ((F.col("event_type") == "view") & (F.col("value") > 95)).alias("timed_out"),
        F.when((F.col("event_type") == "click") & (F.col("value") > 98), "no such file").alias("error"),
    )
    return A.apply_decode_samples(files, samples)


DECODE_SQL = """
  WITH f AS (SELECT user_id::VARCHAR AS path, max(event_id) AS m FROM events GROUP BY 1),
  s AS (SELECT user_id::VARCHAR AS path, (event_id % 100000 + 1) / 200000.0::DOUBLE AS frac,
               event_type = 'error' AND value > 90 AS failed, event_type = 'view' AND value > 95 AS slow,
               event_type = 'click' AND value > 98 AS broken FROM events),
  first_bad AS (SELECT path, min(frac) AS frac, arg_min(slow, frac) AS slow, arg_min(broken, frac) AS broken
                FROM s WHERE failed OR slow OR broken GROUP BY path),
  j AS (SELECT f.path, m * 0.5::DOUBLE AS duration_s, m % 5 <> 0 AS probe_ok, m % 7 = 0 AS was, frac, slow, broken,
               frac IS NOT NULL AND m % 5 <> 0 AND m % 7 <> 0 AND m > 0 AS hit
        FROM f LEFT JOIN first_bad USING (path))
  SELECT path, duration_s, probe_ok, was OR hit AS corrupt,
         CASE WHEN hit AND broken THEN 'ffmpeg error: no such file'
              WHEN hit AND slow THEN printf('decode timed out at %.0f%%', frac * 100)
              WHEN hit THEN printf('frame decode failed at %.0f%% (%.1fs)', frac * 100, duration_s * frac)
              WHEN was THEN 'no video stream found' ELSE '' END AS corrupt_reason
  FROM j
"""


def attach_quality(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "n_chars")
    quality = table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("path"), (F.col("quality") * 50.0 + F.col("toxic")).alias("vmaf_mean")
    )
    return A.attach_quality(docs, quality, "7")


def formatters(spark, d):
    li = spread(
        table(spark, d, "lineitem").select(
            "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
        )
    )
    size = (F.col("l_extendedprice") * F.col("l_partkey") * 10).cast("bigint")
    rate = F.col("l_extendedprice") * F.col("l_quantity") - 20000.0
    seconds = F.col("l_extendedprice") - 1000.0
    eff = F.when(F.col("l_linenumber") == 7, F.lit(float("inf"))).otherwise(F.col("l_tax") * 1.00125)
    vmaf = F.when(F.col("l_linenumber") != 3, F.col("l_quantity") * 1.115)
    name = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))
    return li.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice",
        X.fmt_size(size).alias("size"),
        X.fmt_bitrate(rate).alias("bitrate"),
        X.fmt_efficiency(eff).alias("efficiency"),
        X.fmt_codec_factor(F.col("l_discount") * 10.0).alias("factor"),
        X.fmt_vmaf(vmaf).alias("vmaf"),
        X.duration_hms(seconds).alias("duration"),
        M.resolution(F.col("l_linenumber") - 1, F.col("l_partkey")).alias("resolution"),
        M.pixels(F.col("l_linenumber"), F.col("l_partkey")).alias("pixels"),
        X.fixed(M.size_mb(size), 2).alias("size_mb"),
        X.truncate_text(name, 8).alias("short_name"),
        X.season_ep_label(F.col("l_linenumber"), F.col("l_partkey")).alias("label"),
    )


FORMATTERS_SQL = f"""
  SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, {_fmt_size_sql('size')} AS size,
         {_fmt_bitrate_sql('rate')} AS bitrate,
         CASE WHEN l_linenumber = 7 THEN 'N/A' ELSE printf('%.4f', l_tax * 1.00125::DOUBLE) END AS efficiency,
         printf('%.1fx', l_discount * 10.0::DOUBLE) AS factor,
         CASE WHEN l_linenumber = 3 THEN 'N/A' ELSE printf('%.2f', l_quantity * 1.115::DOUBLE) END AS vmaf,
         {_hms_sql('secs')} AS duration,
         CASE WHEN l_linenumber = 1 OR l_partkey = 0 THEN 'unknown' ELSE (l_linenumber - 1) || 'x' || l_partkey END AS resolution,
         l_linenumber * l_partkey AS pixels, printf('%.2f', size / 1048576.0::DOUBLE) AS size_mb,
         CASE WHEN length(name) > 8 THEN left(name, 7) || '…' ELSE name END AS short_name,
         printf('S%02dE%02d', l_linenumber, l_partkey) AS label
  FROM (SELECT *, trunc(l_extendedprice * l_partkey * 10)::BIGINT AS size,
               l_extendedprice * l_quantity - 20000.0::DOUBLE AS rate, l_extendedprice - 1000.0::DOUBLE AS secs,
               l_orderkey || '-' || l_partkey AS name FROM lineitem)
"""


def sort_top(spark, d):
    """Top-50 report, once per sort key and direction."""
    files = table(spark, d, "orders").select(
        F.concat(F.lit("/lib/f"), F.col("o_orderkey").cast("string")).alias("path"),
        F.col("o_custkey").alias("size_bytes"),
        F.col("o_totalprice").alias("bitrate_bps"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") % 100 * 1.0).alias("vmaf_mean"),
        F.when(F.col("o_orderstatus") == "P", F.lit(float("inf"))).otherwise(F.col("o_totalprice")).alias("norm_efficiency"),
    )
    out = None
    for key in ("efficiency", "vmaf", "size", "bitrate", "name"):
        for desc in (False, True):
            top = A.sort_report(files, key, desc).limit(50).select(
                F.lit(key).alias("sort_key"), F.lit(desc).alias("turned"), "path"
            )
            out = top if out is None else out.unionByName(top)
    return out


def _sort_top_sql() -> str:
    keys = {
        "efficiency": ["isinf(eff)", "eff"],
        "vmaf": ["vmaf IS NULL", "-coalesce(vmaf, 0)"],
        "size": ["o_custkey"],
        "bitrate": ["o_totalprice"],
        "name": ["'f' || o_orderkey"],
    }
    base = """(SELECT *, '/lib/f' || o_orderkey AS path,
      CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 100 * 1.0::DOUBLE END AS vmaf,
      CASE WHEN o_orderstatus = 'P' THEN 'inf'::DOUBLE ELSE o_totalprice END AS eff FROM orders)"""
    parts = []
    for key, cols in keys.items():
        for desc in (False, True):
            order = ", ".join(f"{c} {'DESC' if desc else 'ASC'}" for c in cols)
            parts.append(
                f"SELECT * FROM (SELECT '{key}' AS sort_key, {desc} AS turned, path FROM {base} "
                f"ORDER BY {order}, path LIMIT 50)"
            )
    return " UNION ALL ".join(parts)


SORT_KEYS = {
    "efficiency": ["isinf(eff)", "eff"],
    "vmaf": ["vmaf IS NULL", "-coalesce(vmaf, 0)"],
    "size": ["o_custkey"],
    "bitrate": ["o_totalprice"],
    "codec": ["o_orderpriority"],
    "fps": ["(o_custkey % 7)::DOUBLE"],
    "duration": ["(o_orderkey % 7200)::DOUBLE"],
    "resolution": ["(o_custkey % 50) * (o_orderkey % 40)"],
    "name": ["'f' || o_orderkey"],
}


def sort_places(spark, d):
    """Every file's place in the report, for all nine keys in both directions."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    files = table(spark, d, "orders").select(
        F.concat(F.lit("/lib/f"), key.cast("string")).alias("path"),
        cust.alias("size_bytes"), F.col("o_totalprice").alias("bitrate_bps"), F.col("o_orderpriority").alias("codec"),
        (cust % 7).cast("double").alias("fps"), (key % 7200).cast("double").alias("duration_s"),
        (cust % 50).alias("width"), (key % 40).alias("height"),
        F.when(key % 5 != 0, cust % 100 * 1.0).alias("vmaf_mean"),
        F.when(F.col("o_orderstatus") == "P", F.lit(float("inf"))).otherwise(F.col("o_totalprice")).alias("norm_efficiency"),
    )
    return A.report_places(files)


def _sort_places_sql() -> str:
    base = """(SELECT *, '/lib/f' || o_orderkey AS path,
      CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 100 * 1.0::DOUBLE END AS vmaf,
      CASE WHEN o_orderstatus = 'P' THEN 'inf'::DOUBLE ELSE o_totalprice END AS eff FROM orders)"""
    parts = []
    for key, cols in SORT_KEYS.items():
        for desc in (False, True):
            order = ", ".join(f"{c} {'DESC' if desc else 'ASC'}" for c in cols)
            parts.append(f"SELECT '{key}' AS sort_key, {desc} AS turned, path, row_number() OVER (ORDER BY {order}, path) AS place FROM {base}")
    return " UNION ALL ".join(parts)


def path_top(spark, d):
    """Each page with its place in component-wise path order."""
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    placed = ranked(pages.withColumn("parts", F.split("path", "/")), ["parts", "page_id"], name="place")
    return placed.select("page_id", "path", "place")


def filter_report(spark, d):
    graded = graded_parts(spark, d)
    hit = A.filter_report(graded, "p_name", "RING", A.is_bloated())
    return hit.select("p_partkey", "p_name", "grade")


MEDIA_AUDIT_SQL = f"""
  SELECT path, size_bytes, codec, corrupt, corrupt_reason, percentile, grade, round(norm_efficiency, 9) AS norm_efficiency
  FROM ({AUDITED_SQL})"""

QUERIES = {
    "q_norm_efficiency": (norm_efficiency, f"""
      SELECT p_partkey, codec_factor, round(raw_efficiency, 6) AS raw_efficiency,
             round(norm_efficiency, 6) AS norm_efficiency FROM ({SCORED_SQL})"""),
    "q_percentile_grade": (percentile_grade, f"""
      SELECT p_partkey, round(norm_efficiency, 6) AS norm_efficiency, percentile, grade FROM ({GRADED_SQL})"""),
    "q_grade_by_group": (grade_by_group, GRADE_BY_GROUP_SQL),
    "q_summary": (summary, """
      SELECT count(*) AS scanned, count(*) FILTER (WHERE o_orderstatus <> 'P') AS valid,
             count(*) FILTER (WHERE o_orderstatus = 'P') AS corrupt, sum(o_custkey)::BIGINT AS total_bytes,
             coalesce(sum(o_custkey) FILTER (WHERE o_orderstatus <> 'P'), 0)::BIGINT AS valid_bytes,
             bool_or(o_orderstatus = 'P') AS any_corrupt FROM orders"""),
    "q_codec_counts": (codec_counts, "SELECT p_type, count(*) AS n FROM part GROUP BY p_type"),
    "q_grade_counts": (grade_counts, f"SELECT grade, count(*) AS n FROM ({GRADED_SQL}) GROUP BY grade"),
    "q_extremes": (efficiency_extremes, f"""
      SELECT round(avg(norm_efficiency), 6) AS mean, arg_min(p_partkey, (norm_efficiency, p_partkey)) AS best_path,
             round(min(norm_efficiency), 6) AS best, arg_min(p_partkey, (-norm_efficiency, p_partkey)) AS worst_path,
             round(max(norm_efficiency), 6) AS worst FROM ({SCORED_SQL}) WHERE NOT isinf(norm_efficiency)"""),
    "q_quality_extremes": (quality_extremes, """
      SELECT round(avg(quality), 6) AS mean, max(quality)::DOUBLE AS best, min(quality)::DOUBLE AS worst,
             min(doc_id) FILTER (WHERE quality = (SELECT max(quality) FROM labels)) AS best_path,
             min(doc_id) FILTER (WHERE quality = (SELECT min(quality) FROM labels)) AS worst_path
      FROM documents JOIN labels USING (doc_id)"""),
    "q_probe_payloads": (probe_payloads, f"SELECT * EXCLUDE (o_orderkey) FROM ({PROBE_SQL})"),
    "q_verdict": (verdict, f"""
      SELECT path, has_payload AS probe_ok, corrupt, corrupt_reason, codec_factor,
             round(raw_efficiency, 9) AS raw_efficiency, round(norm_efficiency, 9) AS norm_efficiency
      FROM ({VERDICT_SQL})"""),
    "q_media_audit": (media_audit, MEDIA_AUDIT_SQL),
    "q_audit_csv_rows": (audit_csv_rows, AUDIT_CSV_SQL),
    "q_audit_text": (audit_text, AUDIT_TEXT_SQL),
    "q_vmaf_logs": (vmaf_logs, """
      SELECT event_id::VARCHAR AS path,
             CASE WHEN event_type NOT IN ('error', 'signup') THEN value END AS vmaf_mean FROM events"""),
    "q_media_names": (media_names, MEDIA_NAMES_SQL),
    "q_decode_samples": (decode_samples, DECODE_SQL),
    "q_attach_quality": (attach_quality, """
      SELECT d.doc_id::VARCHAR AS path, n_chars,
             CASE WHEN d.doc_id = 7 THEN 100.0::DOUBLE ELSE quality * 50.0::DOUBLE + toxic END AS vmaf_mean,
             '7' AS vmaf_reference FROM documents d LEFT JOIN labels USING (doc_id)"""),
    "q_formatters": (formatters, FORMATTERS_SQL),
    "q_sort_top": (sort_top, _sort_top_sql()),
    "q_sort_places": (sort_places, _sort_places_sql()),
    "q_path_top": (path_top, """
      SELECT page_id, url AS path, row_number() OVER (ORDER BY string_split(url, '/'), page_id) AS place FROM pages"""),
    "q_filter_report": (filter_report, f"""
      SELECT p_partkey, p_name, grade FROM ({GRADED_SQL})
      WHERE contains(lower(p_name), 'ring') AND grade IN ('poor', 'terrible')"""),
}
