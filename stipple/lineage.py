"""Cutting lineage with files in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: what the session names, else (local sessions only) a fresh one."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="stipple-checkpoint-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: later plans start from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table to the shared folder and read back, for wide rows of which later steps read some columns.

    The shuffle files behind it go once it is written. The table is deleted by ``dropped`` or with the
    session.
    """
    spark = df.sparkSession
    at = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    path, fs = _path(spark, at)
    fs.deleteOnExit(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # A new frame: what is cleaned up is decided when it is made.
        df.select("*").write.option("compression", "snappy").parquet(at)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(at)
    out._stipple_table = at
    return out


def dropped(table: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing will read any more."""
    path, fs = _path(table.sparkSession, table._stipple_table)
    fs.delete(path, True)


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one for files that tasks write; deleted by ``removed`` or with the session."""
    at = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    path, fs = _path(spark, at)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


def removed(spark: SparkSession, at: str) -> None:
    """Deletes a folder of ``folder``."""
    path, fs = _path(spark, at)
    fs.delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
