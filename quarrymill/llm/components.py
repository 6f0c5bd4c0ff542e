"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import dispose, materialise


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every linked node.

    ``links`` has ``a, b``.  Each round hangs a node's larger neighbours on its smallest
    (large star), then its smaller ones (small star); a round is two aggregations and
    two joins, all distributed (ids of any ordered type), and the number of rounds grows as the logarithm of the
    longest path.  Tables of links are written to the shared folder between rounds."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        # a node's smaller neighbours, and itself, hang on the smallest of them
        small = large.join(least2, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        following = materialise(small, "edges")
        dispose(edges)
        edges, before, state = following, state, _state(following)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Number of links and two digests of them, in one pass."""
    code = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(code), F.sum(F.pmod(code, F.lit(1 << 31)))).first())
