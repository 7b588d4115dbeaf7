"""The folder that the driver and the executors share, for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where that is unset and everything runs in one process (tests).

    On a cluster without that setting this is an error: executors would write to disks of their own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tomolake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_recorded: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    top = f"{shared_dir(spark)}/tomolake/{uuid.uuid4().hex}"
    if _recorded:
        _recorded[-1].append(top)
    return f"{top}/{name}"


@contextmanager
def dropped_after(spark: SparkSession) -> Iterator[None]:
    """Folders made by new_path() and written() inside are deleted at the end: for what only an inner step needs."""
    _recorded.append([])
    try:
        yield
    finally:
        for path in _recorded.pop():
            drop_path(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(df: DataFrame, name: str, old: str | None = None) -> tuple[DataFrame, str]:
    """df as written() gives it, and its path; what it was made from is deleted. For loops that rewrite a table."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if old:
        drop_path(df.sparkSession, old)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
