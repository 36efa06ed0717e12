"""Audit report sinks: fixed-column CSV and fixed-width text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.functions import media as M
from sparkaudit.functions import text as X
from sparkaudit.operators.audit import sort_keys

# Headers and widths of the text report.
TEXT_COLUMNS = [
    ("NormEff", 8), ("RawEff", 8), ("VMAF", 6), ("Codec", 7), ("Factor", 7), ("Grade", 9), ("Pctile", 7),
    ("Size", 9), ("Resolution", 12), ("Bitrate", 10), ("Duration", 9),
]


#: Plain CSV: quotes doubled, blanks at the ends of a field kept.
CSV = {
    "header": True, "emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}

# The columns of the CSV report.
AUDIT_COLUMNS = [
    "path", "filename", "size_bytes", "size_mb", "codec", "codec_factor", "width", "height", "resolution",
    "duration_s", "duration_hms", "fps", "bitrate_bps", "bitrate_fmt", "raw_efficiency", "norm_efficiency",
    "vmaf_mean", "vmaf_reference", "percentile", "grade", "format_name", "audio_codecs", "corrupt",
    "corrupt_reason",
]


def audit_rows(df: DataFrame, *extra: Column) -> DataFrame:
    """The 24 report columns, formatted as text."""
    c = F.col
    return df.select(
        "path",
        M.file_name(c("path")).alias("filename"),
        "size_bytes",
        X.fixed(M.size_mb(c("size_bytes")), 2).alias("size_mb"),
        "codec",
        X.fixed(c("codec_factor"), 2).alias("codec_factor"),
        "width",
        "height",
        M.resolution(c("width"), c("height")).alias("resolution"),
        X.fixed(c("duration_s"), 2).alias("duration_s"),
        X.duration_hms(c("duration_s")).alias("duration_hms"),
        X.fixed(c("fps"), 3).alias("fps"),
        X.fixed(c("bitrate_bps"), 0).alias("bitrate_bps"),
        X.fmt_bitrate(c("bitrate_bps")).alias("bitrate_fmt"),
        X.fmt_efficiency(c("raw_efficiency")).alias("raw_efficiency"),
        X.fmt_efficiency(c("norm_efficiency")).alias("norm_efficiency"),
        X.fmt_vmaf(c("vmaf_mean")).alias("vmaf_mean"),
        F.coalesce("vmaf_reference", F.lit("")).alias("vmaf_reference"),
        X.fixed(F.coalesce("percentile", F.lit(0.0)), 1).alias("percentile"),
        F.coalesce("grade", F.lit("")).alias("grade"),
        "format_name",
        F.array_join("audio_codecs", ", ").alias("audio_codecs"),
        F.when(c("corrupt"), "yes").otherwise("no").alias("corrupt"),
        "corrupt_reason",
        *extra,
    )


def _ordered(sort_by: str, desc: bool) -> list[Column]:
    """Good rows in report order, then corrupt rows in path order."""
    keys = [F.when(~F.col("corrupt"), k) for k in sort_keys(sort_by)]
    turned = [k.desc() if desc else k.asc() for k in keys]
    return [F.col("corrupt").asc(), *turned, F.split("path", "/").asc()]


def write_audit_csv(df: DataFrame, path: str, sort_by: str = "efficiency", desc: bool = False) -> None:
    ordered = df.orderBy(*_ordered(sort_by, desc))
    audit_rows(ordered).write.mode("overwrite").options(**CSV).csv(path)


def audit_text_lines(
    df: DataFrame, sort_by: str = "efficiency", desc: bool = False, title: str = "MEDIA AUDIT REPORT"
) -> DataFrame:
    """Report lines in order: heading, valid files, corrupt files."""
    rule, thin = "=" * 100, "-" * 100
    turn = "desc" if desc else "asc"
    columns = "  ".join([name.rjust(width) for name, width in TEXT_COLUMNS] + ["Filename"])
    counts = df.agg(
        F.count_if(~F.col("corrupt")).alias("good"), F.count_if(F.col("corrupt")).alias("bad")
    )
    head = F.array(
        F.lit(title), F.lit(rule), F.lit(""),
        F.concat(F.lit("Valid files ("), F.col("good"), F.lit(f") — sorted by {sort_by} ({turn})")),
        F.lit("NormEff = codec-normalised efficiency (H.264 baseline). Lower is more efficient."),
        F.lit("Grade   = percentile rank within this library."),
        F.lit(""), F.lit(thin), F.lit(columns), F.lit(thin),
    )
    bad_title = F.concat(F.lit("CORRUPT / UNREADABLE FILES ("), F.col("bad"), F.lit(")"))
    bad_head = F.when(F.col("bad") > 0, F.array(F.lit(""), F.lit(rule), bad_title, F.lit(thin)))
    heads = counts.select(
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("_section"), head.alias("_head")),
                F.struct(F.lit(2).alias("_section"), bad_head.alias("_head")),
            )
        )
    )
    cell = {name: F.col(name) for name in AUDIT_COLUMNS}
    line = F.concat_ws(
        "  ",
        X.pad_left(cell["norm_efficiency"], 8),
        X.pad_left(cell["raw_efficiency"], 8),
        X.pad_left(cell["vmaf_mean"], 6),
        X.pad_right(cell["codec"], 7),
        X.pad_left(cell["codec_factor"], 7),
        X.pad_right(cell["grade"], 9),
        X.pad_left(F.concat(cell["percentile"], F.lit("%")), 7),
        X.pad_left(F.concat(cell["size_mb"], F.lit(" MB")), 9),
        X.pad_right(cell["resolution"], 12),
        X.pad_left(cell["bitrate_fmt"], 10),
        X.pad_left(cell["duration_hms"], 9),
        cell["filename"],
    )
    bad_lines = F.array(
        F.concat(F.lit("  [CORRUPT] "), F.col("path")),
        F.concat(F.lit("            Reason: "), F.col("corrupt_reason")),
        F.concat(F.lit("            Size:   "), X.fmt_size(F.col("size_bytes"))),
        F.lit(""),
    )
    names = [f"_k{i}" for i in range(len(sort_keys(sort_by)))]
    keys = [F.when(~F.col("corrupt"), k).alias(n) for k, n in zip(sort_keys(sort_by), names)]
    section = F.when(F.col("corrupt"), 3).otherwise(1).alias("_section")
    parts = df.select("*", section, *keys).unionByName(heads, allowMissingColumns=True)
    turned = [F.col(n).desc() if desc else F.col(n).asc() for n in names]
    # Rows are put in order before they are formatted: the sort looks at its input twice, once to sample it.
    ordered = parts.orderBy("_section", *turned, F.split("path", "/"))
    lines = F.when(F.col("corrupt") == "yes", bad_lines).otherwise(F.array(line))
    rows = audit_rows(ordered, F.col("_section"), F.col("_head"))
    return rows.select(F.explode(F.when(F.col("_section") % 2 == 0, F.col("_head")).otherwise(lines)).alias("value"))


def write_audit_text(df: DataFrame, path: str, sort_by: str = "efficiency", desc: bool = False, **kw) -> None:
    audit_text_lines(df, sort_by, desc, **kw).write.mode("overwrite").text(path)

