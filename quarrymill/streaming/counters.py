"""Counters of outcomes in a stream's state, with a time to live, timers and a store that replays well.

A bucket's counters start anew once it was quiet for longer than the time to live, in event time:
an outcome that comes later finds them expired, and a timer clears the state of a bucket that none
comes for.  Before the state, each task folds its outcomes of a bucket into segments without such
a pause, so a hot bucket sends a few rows a batch, not all of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "attempts long, successes long, first_us long, last_us long, starts long"
SEGMENT = "bucket string, at timestamp, first_us long, last_us long, attempts long, successes long"
COUNTERS = "bucket string, attempts long, successes long, last_us long, starts long, expired boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def segments(ttl_us: int):
    """Outcomes (``bucket, at, us, success``) as runs without a pause beyond the time to live."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            rows = batch.sort_values(["bucket", "us"], kind="stable")
            turn = (rows["bucket"] != rows["bucket"].shift()) | (rows["us"] - rows["us"].shift() > ttl_us)
            found = rows.groupby(turn.cumsum(), sort=False)
            yield pd.DataFrame({"bucket": found["bucket"].first(), "at": found["at"].max(), "first_us": found["us"].min(), "last_us": found["us"].max(), "attempts": found.size(), "successes": found["success"].sum()}).reset_index(drop=True)

    return run


class BucketCounters(StatefulProcessor):
    """Counters of one bucket: attempts, successes, when last touched, how often begun."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts = successes = first = last = starts = 0
        if self.counters.exists():
            attempts, successes, first, last, starts = self.counters.get()
        found = pd.concat(list(rows)).sort_values("first_us", kind="stable")  # segments: a few a task
        for begin, end, n, good in zip(found["first_us"], found["last_us"], found["attempts"], found["successes"], strict=True):
            if not starts or begin - last > self.ttl_us:
                attempts, successes, first, starts = 0, 0, int(begin), starts + 1
                last = int(end)
            attempts, successes, last = attempts + int(n), successes + int(good), max(last, int(end))
        self.counters.update((attempts, successes, first, last, starts))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.ttl_us) // 1000 + 1)
        yield pd.DataFrame([(key[0], attempts, successes, last, starts, False)], columns=["bucket", "attempts", "successes", "last_us", "starts", "expired"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, _, _, last, starts = self.counters.get()
        self.counters.update((0, 0, 0, last, starts))
        yield pd.DataFrame([(key[0], 0, 0, last, starts, True)], columns=["bucket", "attempts", "successes", "last_us", "starts", "expired"])

    def close(self) -> None:
        pass


def expiring_counters(outcomes: DataFrame, ttl_seconds: int, delay: str = "1 hour") -> DataFrame:
    """Updates of each bucket's counters; ``outcomes`` is a stream of ``bucket, at, success``.  Needs the
    state store of ``PROVIDER``.  Outcomes beyond the watermark are dropped."""
    ttl_us = ttl_seconds * 1_000_000
    timed = outcomes.withColumn("us", F.unix_micros("at")).select("bucket", "at", "us", F.coalesce("success", F.lit(False)).cast("int").alias("success"))
    folded = timed.mapInPandas(segments(ttl_us), SEGMENT).withWatermark("at", delay)
    return folded.groupBy("bucket").transformWithStateInPandas(BucketCounters(ttl_us), COUNTERS, "Update", "EventTime")


def store_batches(updates: DataFrame, store: str, checkpoint: str, mode: str = "update") -> None:
    """Runs what is there to its end; each batch is one folder of the store, named by its number, so
    that a batch that runs twice after a failure is there once."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    query = updates.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_counters(spark: SparkSession, store: str) -> DataFrame:
    """Each bucket's counters after its last outcome."""
    rows = spark.read.schema(COUNTERS + ", batch long").parquet(store).where("NOT expired")
    return rows.groupBy("bucket").agg(F.max_by(F.struct("attempts", "successes", "last_us", "starts"), "batch").alias("x")).select("bucket", "x.*")


def fold_parts(events: DataFrame) -> DataFrame:
    """What one batch says of each (job, sha), in a form of which any two can be merged."""
    from quarrymill.operators.rules import action_sign

    order = F.struct("t", "job", "svg_sha", "event", "pos")
    sign, shown, placed = action_sign(dict(events.dtypes)), F.col("event") == "shown", F.col("pos").isNotNull()
    return events.where("svg_sha IS NOT NULL").groupBy("job", "svg_sha").agg(
        F.coalesce(F.bool_or(shown), F.lit(False)).alias("shown"), F.max(F.when(shown & placed, order)).alias("seen_at"), F.min(F.when(~shown & placed, order)).alias("acted_at"),
        F.max(sign).alias("best"), F.min(sign).alias("worst"), F.max("t").alias("last_t"),
    )


def merged_fold(parts: DataFrame) -> DataFrame:
    """The fold of all batches of a store: the same rows as ``fold_events`` over the whole log."""
    every = parts.groupBy("job", "svg_sha").agg(F.bool_or("shown").alias("shown"), F.max("seen_at").alias("seen_at"), F.min("acted_at").alias("acted_at"), F.max("best").alias("best"), F.min("worst").alias("worst"), F.max("last_t").alias("last_t"))
    action = F.when(F.col("best") > 0, 1).when(F.col("worst") < 0, -1).otherwise(0)
    return every.select("job", "svg_sha", "shown", F.coalesce("seen_at.pos", "acted_at.pos").alias("pos"), action.alias("action"), "last_t")


def store_folds(events: DataFrame, store: str, checkpoint: str) -> None:
    """Folds a stream of events into the store, a part a batch; a batch that is replayed replaces its part."""

    def keep(batch: DataFrame, number: int) -> None:
        fold_parts(batch).write.mode("overwrite").parquet(f"{store}/batch={number}")

    query = events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
