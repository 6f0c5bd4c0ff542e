"""Shared helpers of the training-data operators.

Nothing outside this subpackage imports it.  Inputs are always read by Spark's
own readers, and every intermediate table goes to the shared folder that the
cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that part words: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
BLANK_BYTES = BLANKS.encode()
#: The same as a Java character class.
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Where it is unset an own folder serves a
    session in one process (tests); executors elsewhere could not see such a folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own_dirs:
        _own_dirs[key] = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
    return _own_dirs[key]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lost executor
    costs a re-read of files, never a re-run of the stages before.  The folder
    is removed by ``dispose``, or when the driver's interpreter ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarrymill/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dispose(*written: DataFrame) -> None:
    """Remove tables that ``materialise`` wrote, once nothing reads them any more.  Shuffle files
    of finished plans go when the driver's JVM collects those plans, so it is asked to."""
    for df in written:
        if path := getattr(df, "_written", None):
            _remove(df.sparkSession, path)
    if written:
        gc.collect()
        written[0].sparkSession.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone already; the folder is then the cluster's to clear
        pass


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of non-blank characters (null and blank texts: empty)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_CLASS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without building them: blanks at the ends go, runs become cuts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANK_CLASS + "+"))).cast("long")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; QUARRYMILL_TOKENIZERS names another folder."""
    folder = os.environ.get("QUARRYMILL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
