"""Greedy groups without a sequential pass over all items.

In order of ``place``, an item leads a group unless an earlier leader is linked to it; otherwise
it joins the first such leader.  An item can decide once its earlier neighbours have, so many decide
at a time.  A bucket of ``BUCKET`` consecutive places is decided as far as it can be in one task,
whose links are those inside the bucket; what stands in other buckets comes as two flags.  Rounds
go on until all have decided; the result is the sequential rule's."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.scratch import drop, written

BUCKET = 1024
OPEN, LEADER, MEMBER = 0, 1, 2


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decides the open items of buckets that follow one another, the earliest first; open ones stay open."""
    state: dict[int, int] = {}
    current = None
    for rows in batches:
        found = []
        for block, bucket, place, known, led, waits, near in zip(rows["block"], rows["bucket"], rows["place"], rows["state"], rows["led"], rows["waits"], rows["near"], strict=True):
            if current != (block, bucket):
                current, state = (block, bucket), {}
            if known == OPEN:
                own = [state[p] for p in near] if near is not None else []
                known = MEMBER if led or LEADER in own else OPEN if waits or OPEN in own else LEADER
            state[place] = known
            found.append(known)
        yield pd.DataFrame({"block": rows["block"], "place": rows["place"], "state": found})


def first_leaders(items: DataFrame, links: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``block, place, leader`` of items (``block, place``); ``links`` has ``block, place, earlier``."""
    kind = dict(items.dtypes)["block"]
    links = written(links.select("block", "place", "earlier").distinct().withColumn("inside", F.floor(F.col("place") / bucket) == F.floor(F.col("earlier") / bucket)), "links")
    near = links.where("inside").groupBy("block", "place").agg(F.collect_list("earlier").alias("near"))  # at most a bucket
    state = written(items.select("block", "place", F.lit(OPEN).alias("state")), "leaders")
    while not state.where(F.col("state") == OPEN).isEmpty():
        waiting = links.where("NOT inside").join(state.where(F.col("state") == OPEN).select("block", "place").hint("merge"), ["block", "place"], "left_semi")
        seen = waiting.join(state.select("block", F.col("place").alias("earlier"), F.col("state").alias("other")).hint("merge"), ["block", "earlier"])
        flags = seen.groupBy("block", "place").agg(F.bool_or(F.col("other") == LEADER).alias("led"), F.bool_or(F.col("other") == OPEN).alias("waits"))
        busy = state.withColumn("bucket", F.floor(F.col("place") / bucket))
        live = busy.where(F.col("state") == OPEN).select("block", "bucket").distinct()
        rows = busy.join(live.hint("merge"), ["block", "bucket"], "left_semi").join(flags.hint("merge"), ["block", "place"], "left").join(near.hint("merge"), ["block", "place"], "left").fillna(False, ["led", "waits"])
        ordered = rows.select("block", "bucket", "place", "state", "led", "waits", "near").repartition("block", "bucket").sortWithinPartitions("block", "bucket", "place")
        decided = ordered.mapInPandas(_decide, f"block {kind}, place long, state int")
        following = written(decided.unionByName(busy.join(live.hint("merge"), ["block", "bucket"], "left_anti").select("block", "place", "state")), "leaders")
        drop(state)
        state = following
    leaders = state.where(F.col("state") == LEADER)
    joined = links.join(leaders.select("block", F.col("place").alias("earlier")).hint("merge"), ["block", "earlier"]).groupBy("block", "place").agg(F.min("earlier").alias("leader"))
    found = state.join(joined.hint("merge"), ["block", "place"], "left")
    return found.select("block", "place", F.when(F.col("state") == LEADER, F.col("place")).otherwise(F.col("leader")).alias("leader"))
