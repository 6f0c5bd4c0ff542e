"""A folder that driver and executors share, for files that a query writes and reads back."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_collecting: list[list[DataFrame]] = []


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the cluster's ``spark.checkpoint.dir``.  Where that is unset an own folder
    serves a session in one process (tests); other executors could not see such a folder.  What is
    there goes when the driver's interpreter ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quarrymill-"))
    path = f"{base}/quarrymill/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there.  The folder
    is removed by ``drop``, or when the driver's interpreter ends."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    for tables in _collecting:
        tables.append(out)
    return out


@contextmanager
def collected() -> Iterator[list[DataFrame]]:
    """The tables written inside, for ``drop`` once nothing reads them any more."""
    tables: list[DataFrame] = []
    _collecting.append(tables)
    try:
        yield tables
    finally:
        _collecting[:] = [t for t in _collecting if t is not tables]


def once(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back, or itself where it is such a table already."""
    return df if hasattr(df, "_written") else written(df, label)


def drop(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_written", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone already; the folder is then the cluster's to clear
        pass
