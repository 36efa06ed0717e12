"""Sources of the media audit: file listings, landed probe payloads, landed quality logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.functions import media as M
from sparkaudit.functions.text import to_double

STREAM = (
    "struct<codec_type:string,codec_name:string,width:string,height:string,"
    "r_frame_rate:string,bit_rate:string>"
)
PAYLOAD = (
    "struct<format:struct<duration:string,bit_rate:string,format_name:string,format_long_name:string>,"
    f"streams:array<{STREAM}>>"
)


def media_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Keep the rows of a landed file manifest that name a video file."""
    return files.filter(M.is_media_name(M.file_name(F.col(path))))


def scan_media_files(manifest: DataFrame, directory: str, recursive: bool = True) -> DataFrame:
    """Video files of a directory as (path, size_bytes), from a landed manifest of all files.

    A manifest rather than a listing by Spark's file sources: those hide empty files and names
    that start with ``_`` or ``.``, and an audit must see them.
    """
    root = directory.rstrip("/") + "/"
    inside = F.col("path").startswith(root)
    if not recursive:
        inside = inside & (F.locate("/", F.col("path"), len(root) + 1) == 0)
    return media_files(manifest.filter(inside).select("path", "size_bytes"))


def read_probe_payloads(
    df: DataFrame, path: str = "path", payload: str = "payload", size: str = "size_bytes"
) -> DataFrame:
    """Probe JSON text to typed columns; blank, malformed or missing text gives ``has_payload`` false."""
    text = F.col(payload)
    valid = F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{")
    # A generator, not a projection: later filters on the parsed fields stay above it
    # instead of being pushed down as further copies of the parser.
    parsed = df.select(
        F.col(path).alias("path"),
        F.col(size).cast("bigint").alias("size_bytes"),
        F.inline(
            F.array(
                F.struct(
                    F.coalesce(valid, F.lit(False)).alias("has_payload"),
                    F.from_json(F.when(valid, text), PAYLOAD).alias("p"),
                )
            )
        ),
    ).withColumn("v", M.first_video_stream(F.col("p.streams")))
    has_video = F.col("v").isNotNull()
    return parsed.select(
        "path",
        "size_bytes",
        "has_payload",
        has_video.alias("has_video"),
        F.when(has_video, F.coalesce("v.codec_name", F.lit("unknown"))).otherwise("").alias("codec"),
        F.coalesce("p.format.format_long_name", "p.format.format_name", F.lit("")).alias("format_name"),
        F.coalesce(F.col("v.width").try_cast("int"), F.lit(0)).alias("width"),
        F.coalesce(F.col("v.height").try_cast("int"), F.lit(0)).alias("height"),
        to_double(F.col("p.format.duration")).alias("duration_s"),
        M.bitrate(F.col("p.format.bit_rate"), F.col("v.bit_rate")).alias("bitrate_bps"),
        M.parse_rate(F.coalesce("v.r_frame_rate", F.lit("0/1"))).alias("fps"),
        M.audio_codecs(F.col("p.streams")).alias("audio_codecs"),
    )


def read_vmaf_logs(df: DataFrame, path: str = "path", payload: str = "payload") -> DataFrame:
    """Mean quality score per path; null when absent or not a number."""
    mean = F.get_json_object(F.col(payload), "$.pooled_metrics.vmaf.mean")
    return df.select(F.col(path).alias("path"), to_double(mean, None).alias("vmaf_mean"))
