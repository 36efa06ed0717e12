"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of text in one Arrow batch, so that a Python worker's memory is bounded.
BATCH_ROWS, BATCH_BYTES = 2000, "16m"
#: Keys that are sent to the tasks as an array (8 bytes each).
SENT_KEYS = 4_000_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) runs free of the six ASCII blanks; bytes.split cuts at just those."""
    return text.lower().split()


def shipped(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session, wherever it is not installed there."""
    context = spark.sparkContext
    if getattr(context, "_sparkaudit_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="run-")) / "sparkaudit.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for module in package.rglob("*.py"):
            out.write(module, module.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._sparkaudit_shipped = True


def bounded_batches(spark: SparkSession) -> None:
    """Settings of a session that runs these operators: bounded Arrow batches, the package on all workers."""
    shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share; a local one only in a session of one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


#: Folders landed inside the scopes that are open, innermost last.
_scopes: list[list[str]] = []


@contextlib.contextmanager
def landing_scope() -> Iterator[list[str]]:
    """Collects the folders landed inside; the caller deletes them once nothing reads them any more."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def landed(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there, whatever executors are lost."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if _scopes:
        _scopes[-1].append(folder)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def delete_unread(spark: SparkSession, folders: list[str], reader: DataFrame) -> None:
    """Delete landed folders, unless ``reader`` still reads one of them: then all stay."""
    names = [folder.rsplit("/", 1)[-1] for folder in folders]
    if any(name in file for file in reader.inputFiles() for name in names):
        return
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def among(rows: DataFrame, key: Column, keys: DataFrame, inside: bool = True) -> DataFrame | None:
    """Rows whose long ``key`` is one of the single column ``keys`` (or is none of them), without a shuffle of the rows.

    The keys go to the tasks as one sorted array of 8 bytes each; with more than ``SENT_KEYS`` there is no such way: None.
    Null keys are among nothing.
    """
    if not fits(keys, SENT_KEYS):
        return None
    held = keys.toArrow().column(0).drop_null().to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(np.unique(held.astype(np.int64)))

    @F.arrow_udf("boolean")
    def known(column: pa.Array) -> pa.Array:
        sorted_keys = shared.value
        wanted = column.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
        found = sorted_keys[at] == wanted if len(sorted_keys) else np.zeros(len(wanted), dtype=bool)
        return pa.array(found & column.is_valid().to_numpy(zero_copy_only=False))

    return rows.filter(known(key) if inside else ~known(key))


def free_name(taken: list[str], wanted: str) -> str:
    """A column name that no column has yet, whatever its case."""
    used = {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted
