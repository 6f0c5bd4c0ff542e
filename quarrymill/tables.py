"""Input tables.  Timestamps without a zone are cast, so that they can carry a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; columns are pruned and filters pushed down by whatever reads it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    casts = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df
