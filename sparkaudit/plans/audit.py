"""The whole media audit as one plan: landed payloads in, graded rows and reports out."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.landing import landed
from sparkaudit.operators import audit as A
from sparkaudit.sinks.audit import write_audit_csv, write_audit_text
from sparkaudit.sources.media import read_probe_payloads, read_vmaf_logs


def audit_probes(
    probes: DataFrame,
    decode_samples: DataFrame | None = None,
    vmaf_logs: DataFrame | None = None,
    reference: str | None = None,
) -> DataFrame:
    """Probe payloads (path, payload, size_bytes) to one audited row per file.

    Corrupt rows keep percentile 0 and an empty grade.  Only the good rows are
    ranked: a corrupt row's score is masked, so no second scan is needed.
    """
    files = A.with_verdict(read_probe_payloads(probes))
    if decode_samples is not None:
        files = A.apply_decode_samples(files, decode_samples)
    if vmaf_logs is not None and reference is not None:
        files = A.attach_quality(files, read_vmaf_logs(vmaf_logs), reference)
        sound = ~F.col("corrupt")
        files = files.withColumn("vmaf_mean", F.when(sound, F.col("vmaf_mean"))).withColumn(
            "vmaf_reference", F.when(sound, F.col("vmaf_reference")).otherwise("")
        )
    else:
        files = files.withColumn("vmaf_mean", F.lit(None).cast("double")).withColumn("vmaf_reference", F.lit(""))
    rankable = F.when(~F.col("corrupt"), F.col("norm_efficiency"))
    # Ranking reads its input several times; payloads are parsed once.
    ranked = A.percentile_grade(landed(files).withColumn("_rankable", rankable), "_rankable")
    return ranked.drop("_rankable")


def audit_report(audited: DataFrame, directory: str, sort_by: str = "efficiency", desc: bool = False) -> DataFrame:
    """Write the CSV and text reports and return the one-row summary."""
    kept = audited.persist(StorageLevel.DISK_ONLY)
    write_audit_csv(kept, f"{directory}/csv", sort_by, desc)
    write_audit_text(kept, f"{directory}/text", sort_by, desc)
    return A.audit_summary(kept)
