"""The event log as a stream: counters with a time to live, and an exactly-once fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.plans.events import _FOLD, event_log
from quarrymill.plans.registry import Family
from quarrymill.scratch import folder
from quarrymill.streaming import counters, exposure
from quarrymill.tables import load

family = Family()

TTL_HOURS = 20
SLICES = 4


def _sliced(df: DataFrame, by: str, path: str, slices: range) -> None:
    """Writes the rows of some slices of the log, one after the other, as files that a stream takes in that order."""
    for k in slices:
        df.where(F.col(by) == k).drop(by).write.mode("append").parquet(path)


@family.query(
    f"""WITH b AS (SELECT event_type || '|' || CAST(user_id % 7 AS VARCHAR) AS bucket, value > 50 AS good, ts FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY bucket ORDER BY ts) <= INTERVAL {TTL_HOURS} HOUR THEN 0 ELSE 1 END AS opens FROM b),
s AS (SELECT *, sum(opens) OVER (PARTITION BY bucket ORDER BY ts) AS life FROM g), m AS (SELECT bucket, max(life) AS starts FROM s GROUP BY 1)
SELECT s.bucket, count(*) AS attempts, count(*) FILTER (good) AS successes, epoch_us(max(ts)) AS last_us, CAST(any_value(m.starts) AS BIGINT) AS starts FROM s JOIN m ON m.bucket = s.bucket AND m.starts = s.life GROUP BY s.bucket"""
)
def expiring_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each bucket since it was last quiet for longer than the time to live: the first half
    of the log as a stream, then, from its checkpoint, the rest."""
    path, store, checkpoint = (folder(spark, n) for n in ("outcomes", "counters", "checkpoint"))
    bucket = F.concat("event_type", F.lit("|"), (F.col("user_id") % 7).cast("string"))
    log = load(spark, sf_dir, "events").select(bucket.alias("bucket"), F.col("ts").alias("at"), (F.col("value") > 50).alias("success"))
    edge = log.agg(F.min("at").cast("double").alias("lo"), F.max("at").cast("double").alias("hi")).first()
    width = max(((edge["hi"] or 0.0) - (edge["lo"] or 0.0)) / SLICES, 1.0)
    log = log.withColumn("slice", F.least(F.floor((F.col("at").cast("double") - F.lit(edge["lo"] or 0.0)) / width), F.lit(SLICES - 1)))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, counters.PROVIDER)
    try:
        for part in (range(SLICES // 2), range(SLICES // 2, SLICES)):
            _sliced(log, "slice", path, part)
            stream = spark.readStream.schema("bucket string, at timestamp, success boolean").option("maxFilesPerTrigger", 1_000).parquet(path)
            counters.store_batches(counters.expiring_counters(stream, TTL_HOURS * 3600), store, checkpoint)
    finally:
        spark.conf.set(name, before)
    return counters.latest_counters(spark, store)


@family.query(f"WITH {_FOLD} SELECT job, sha, shown, pos, action, last_t FROM fold")
def streamed_event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event fold out of a stream, batch by batch, in an order in which actions also come before their
    exposures; repeats of a line within the watermark's delay are dropped, and a batch counts once."""
    path, store, checkpoint = (folder(spark, n) for n in ("log", "folds", "checkpoint"))
    log = event_log(spark, sf_dir).withColumn("slice", F.pmod(F.xxhash64("t", "svg_sha"), F.lit(2)))
    twice = log.unionByName(log.where(F.col("pos") % 5 == 0))
    kind = "t string, job string, svg_sha string, event string, pos int, value double"
    for part in (range(1), range(1, 2)):
        _sliced(twice, "slice", path, part)
        stream = exposure.without_repeats(spark.readStream.schema(kind).parquet(path), "365 days")
        counters.store_folds(stream, store, checkpoint)
    parts = spark.read.parquet(store).drop("batch")
    folded = counters.merged_fold(parts).withColumnRenamed("svg_sha", "sha")
    return folded.withColumns({"pos": F.col("pos").cast("long"), "action": F.col("action").cast("long")})
