"""Streams of the event log: exposure fold, counters, and windows with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators.learning import fold_events
from quarrymill.schemas import EVENT
from quarrymill.sources.readers import tolerant


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The log as a stream of lines; bad lines are passed over."""
    return tolerant(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path), EVENT)


def without_repeats(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each line once within the delay, by its identity."""
    timed = events.withColumn("at", F.try_to_timestamp("t"))
    return timed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["job", "svg_sha", "event", "pos", "t"])


def exposure_fold(events: DataFrame) -> DataFrame:
    """State of each (job, sha); for ``complete`` or ``update`` output, so that an action
    that arrives before its exposure still counts.  The same fold as in batch."""
    return fold_events(events)


def bucket_counters(outcomes: DataFrame) -> DataFrame:
    """Counters with the time last touched; expiry is applied where they are read."""
    return outcomes.groupBy("bucket").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("successes"), F.max("t").alias("last_t"))


def windowed_counts(events: DataFrame, time: str = "ts", size: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Tumbling or sliding counts (an extension); late rows are dropped after the delay."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, delay).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def drain(df: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """Run what is there to its end, into an in-memory table (for tests and small reports)."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
