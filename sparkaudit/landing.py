"""Tables written to the folder that all executors share and read back: costly work is done once, whatever reads it later."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_landed: list[str] = []


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only in a session of one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def landed(df: DataFrame, folders: list[str] | None = None) -> DataFrame:
    """The table as Parquet, read back; its lineage ends there.

    Its folder goes when the program ends, or by ``forget_landed``; it is added to ``folders`` for that.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "landed")
    if not _landed:
        atexit.register(forget_landed)
    _landed.append(folder)
    if folders is not None:
        folders.append(folder)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget_landed(folders: list[str] | None = None) -> None:
    """Delete landed tables, all of this program's or those of the given folders; nothing may read them any more."""
    spark = SparkSession.getActiveSession()
    for folder in list(_landed if folders is None else folders):
        if spark is not None and folder in _landed:
            delete_folder(spark, folder)
            _landed.remove(folder)
