"""Column functions of the media audit: probe fields, verdicts, scores, derived properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkaudit.functions.text import to_double

INF = float("inf")

# Bits-per-quality factors by codec name, H.264 = 1.0.
CODEC_FACTORS = {
    "mpeg1video": 0.3,
    "mpeg2video": 0.4,
    "vc1": 0.5,
    "wmv1": 0.4,
    "wmv2": 0.45,
    "wmv3": 0.5,
    "rv40": 0.5,
    "rv30": 0.4,
    "rv20": 0.35,
    "flv1": 0.4,
    "svq3": 0.4,
    "h261": 0.2,
    "h263": 0.35,
    "h263p": 0.4,
    "mjpeg": 0.25,
    "dvvideo": 0.2,
    "mpeg4": 0.7,
    "msmpeg4v3": 0.6,
    "msmpeg4v2": 0.55,
    "msmpeg4v1": 0.5,
    "h264": 1.0,
    "avc": 1.0,
    "vp8": 0.9,
    "vp9": 1.4,
    "hevc": 1.8,
    "h265": 1.8,
    "av1": 2.5,
    "libaom-av1": 2.5,
    "ffv1": 0.15,
    "huffyuv": 0.1,
    "utvideo": 0.1,
    "rawvideo": 0.05,
    "v210": 0.1,
    "prores": 0.3,
    "dnxhd": 0.3,
    "dnxhr": 0.3,
    "cineform": 0.3,
}
DEFAULT_FACTOR = 0.8

# Upper percentile of each grade, best first.
GRADE_BANDS = [(20.0, "excellent"), (45.0, "good"), (70.0, "fair"), (88.0, "poor"), (100.0, "terrible")]
UNGRADED = "?"

# File name extensions of video files.
VIDEO_EXTENSIONS = [
    "3g2", "3gp", "3gpp", "3gpp2", "asf", "avi", "dav", "dv", "dvr-ms", "f4v", "flv", "h264", "h265",
    "hevc", "m1v", "m2t", "m2ts", "m2v", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "mts", "mxf", "nuv",
    "ogm", "ogv", "qt", "rm", "rmvb", "ts", "vob", "webm", "wmv", "wtv", "xvid", "y4m",
]


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def has_extension(name: Column, extensions: list[str]) -> Column:
    """Case-insensitive suffix test; a name that is only an extension has no suffix."""
    return name.rlike(r"(?is)^.+\.(" + "|".join(extensions) + ")$")


def is_media_name(name: Column) -> Column:
    return ~name.startswith("._") & has_extension(name, VIDEO_EXTENSIONS)


def first_video_stream(streams: Column) -> Column:
    return F.try_element_at(F.filter(streams, lambda s: s.codec_type == "video"), F.lit(1))


def audio_codecs(streams: Column) -> Column:
    audio = F.filter(streams, lambda s: s.codec_type == "audio")
    return F.coalesce(
        F.transform(audio, lambda s: F.coalesce(s.codec_name, F.lit(""))), F.array().cast("array<string>")
    )


def parse_rate(text: Column) -> Column:
    """``"num/den"`` to a double; 0 when malformed or the denominator is 0."""
    parts = F.split(text, "/")
    num = to_double(F.try_element_at(parts, F.lit(1)), None)
    den = to_double(F.try_element_at(parts, F.lit(2)), None)
    return F.when(F.size(parts) == 2, F.coalesce(F.try_divide(num, den), F.lit(0.0))).otherwise(F.lit(0.0))


def bitrate(container: Column, stream: Column) -> Column:
    """Container bit rate, or the video stream's when the container gives none."""
    outer = to_double(container)
    return F.when(outer == 0, to_double(stream)).otherwise(outer)


def corrupt_reason(has_payload: Column, has_video: Column, duration: Column, width: Column, height: Column) -> Column:
    """First broken rule, '' for a sound file."""
    return (
        F.when(~has_payload, "ffprobe failed to read file")
        .when(~has_video, "no video stream found")
        .when(duration <= 0, "duration is zero or missing")
        .when((width == 0) | (height == 0), "zero-dimension video stream")
        .otherwise("")
    )


def raw_efficiency(bitrate_bps: Column, pixels: Column) -> Column:
    usable = (pixels > 0) & (bitrate_bps > 0) & ~F.isnan(bitrate_bps.cast("double"))
    return F.when(usable, bitrate_bps / pixels).otherwise(F.lit(INF))


def is_scoreable(score: Column) -> Column:
    return score < F.lit(INF)


def grade_of(percentile: Column, bands: list[tuple[float, str]] = GRADE_BANDS) -> Column:
    grade = F.when(percentile <= bands[0][0], bands[0][1])
    for limit, label in bands[1:]:
        grade = grade.when(percentile <= limit, label)
    return grade.otherwise("")


def pixels(width: Column, height: Column) -> Column:
    return width.cast("bigint") * height


def resolution(width: Column, height: Column) -> Column:
    known = (width != 0) & (height != 0)
    return F.when(known, F.concat_ws("x", width.cast("string"), height.cast("string"))).otherwise("unknown")


def size_mb(size_bytes: Column) -> Column:
    return size_bytes / F.lit(1024.0**2)
