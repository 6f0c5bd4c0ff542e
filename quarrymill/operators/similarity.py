"""Character-gram TF-IDF, similar pairs by a gram join, and greedy groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.config import INTENT_THRESHOLD
from quarrymill.functions.text import normal
from quarrymill.operators.greedy import first_leaders

#: Texts whose grams are handed on at once.
GRAM_ROWS = 64


def gram_counts(docs: DataFrame, key: str, text: str, n: int = 2) -> DataFrame:
    """``key, gram, tf``: overlapping n-grams of characters, of a shorter text the whole of it.

    A row's grams are counted where its text is, so that what travels is one row for each distinct gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(key)
            for lo in range(0, batch.num_rows, GRAM_ROWS):
                owner, gram, tf = [], [], []
                for i, s in enumerate(batch.column("s").slice(lo, GRAM_ROWS).to_pylist(), lo):
                    found, times = counted_grams(s or "", n)
                    owner.append(np.full(len(found), i))
                    gram += found
                    tf.append(times)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(owner))), pa.array(gram, pa.string()), pa.array(np.concatenate(tf))], [key, "gram", "tf"])

    kind = docs.schema[key].dataType.simpleString()
    each = docs.select(key, normal(F.col(text)).alias("s")).mapInArrow(count, f"`{key}` {kind}, gram string, tf long")
    return each.repartition(key).groupBy(key, "gram").agg(F.sum("tf").alias("tf"))


def counted_grams(s: str, n: int) -> tuple[list[str], np.ndarray]:
    """Distinct n-grams of a text and how often each occurs."""
    if len(s) <= n:
        return ([s] if s else []), np.ones(min(len(s), 1), dtype=np.int64)
    chars = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    code = chars
    for k in range(1, n):  # an n-gram is numbered by the (n - 1)-gram before it and its last character
        code = np.unique(code[:-1], return_inverse=True)[1] << 21 | chars[k:] if k > 1 else code[:-1] << 21 | chars[1:]
    _, at, times = np.unique(code, return_index=True, return_counts=True)
    return [s[i : i + n] for i in at.tolist()], times.astype(np.int64)


def idf_table(counts: DataFrame, total: DataFrame) -> DataFrame:
    """``gram, df, idf``; ``total`` is one row with ``docs``."""
    df = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(total)).withColumn("idf", F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).drop("docs")  # one row


def unit_vectors(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """``key, gram, w``: weights (1 + ln tf) x idf, of length 1 a document."""
    raw = counts.join(idf, "gram", "left").withColumn("x", (1 + F.log("tf")) * F.coalesce("idf", F.lit(1.0)))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return raw.select(key, "gram", (F.col("x") / norm).alias("w"))


def similar_pairs(vectors: DataFrame, key: str, threshold: float) -> DataFrame:
    """Pairs of unit vectors whose cosine reaches the threshold, by prefix filtering.

    With grams in order of rarity, the rest of a vector beyond its prefix weighs less than
    the threshold, so similar vectors share a gram of both prefixes: only rare grams are
    joined, and the pairs found are scored on their whole vectors."""
    common = vectors.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    ahead = Window.partitionBy(key).orderBy(F.col("df").desc(), "gram").rowsBetween(Window.unboundedPreceding, 0)
    tail = vectors.join(common, "gram").withColumn("tail", F.sum(F.col("w") * F.col("w")).over(ahead))
    prefix = tail.where(F.sqrt("tail") >= threshold - 1e-9).select(key, "gram")
    pairs = prefix.withColumnRenamed(key, "a").join(prefix.withColumnRenamed(key, "b"), "gram").where("a < b").select("a", "b").distinct()
    whole = vectors.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("m"))
    scored = pairs.join(whole.select(F.col(key).alias("a"), F.col("m").alias("x")), "a").join(whole.select(F.col(key).alias("b"), F.col("m").alias("y")), "b")
    dot = F.aggregate(F.map_entries("x"), F.lit(0.0), lambda t, e: t + e["value"] * F.coalesce(F.try_element_at("y", e["key"]), F.lit(0.0)))
    return scored.select("a", "b", dot.alias("cosine")).where(F.col("cosine") >= threshold)


def intent_groups(ids: DataFrame, pairs: DataFrame, key: str, block: str | None = None) -> DataFrame:
    """Greedy groups: the lowest free id is a seed and takes every free id similar to it.
    Ids decide in rounds, once those below them have (see ``greedy``)."""
    own = ids.select(F.col(key).cast("long").alias("place"), (F.col(block) if block else F.lit("all")).alias("block"))
    links = pairs.select(F.greatest("a", "b").cast("long").alias("place"), F.least("a", "b").cast("long").alias("earlier"))
    links = links.join(own, "place").join(own.select(F.col("place").alias("earlier"), "block"), ["earlier", "block"])
    return first_leaders(own, links).select(F.col("place").alias(key), F.col("leader").alias("seed"))


DEFAULT_THRESHOLD = INTENT_THRESHOLD
