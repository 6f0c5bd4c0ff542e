"""One digest for every subtree: attributes in any order, children in theirs.

Digests are made from the deepest level up, all subtrees of a level at once.  A node's children
meet in blocks of their places, whose digests then meet, so a node may have very many."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.scratch import written

BLOCK = 1024
_PART, _PAIR = "\x02", "\x01"


def tree_digests(elements: DataFrame) -> DataFrame:
    """``doc_id, node_id, digest, nodes`` of every element: SHA-256 of its name, its sorted attributes,
    its text (of style elements) and its children's digests; and the size of its subtree.  Elements
    carry ``depth``, one more than their parent's, and ``ord``, the place among siblings."""
    attrs = F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    text = F.coalesce("text", F.lit("")) if "text" in elements.columns else F.lit("")
    own = F.concat_ws(_PART, F.lower("tag"), F.array_join(attrs, _PAIR), text)
    nodes = written(elements.select("doc_id", "node_id", "parent_id", "ord", "depth", own.alias("own")), "nodes")
    span = nodes.agg(F.min("depth"), F.max("depth")).first()
    if span[0] is None:
        return nodes.select("doc_id", "node_id", F.lit("").alias("digest"), F.lit(0).cast("long").alias("nodes")).limit(0)
    levels: list[DataFrame] = []
    for depth in range(span[1], span[0] - 1, -1):
        level = nodes.where(F.col("depth") == depth)
        if levels:
            below = levels[-1].groupBy("doc_id", "parent_id", F.floor(F.col("ord") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("ord", "node_id", "digest"))).alias("c"), F.sum("nodes").alias("below"))
            below = below.select("doc_id", "parent_id", "block", F.sha2(F.array_join("c.digest", ""), 256).alias("part"), "below")
            below = below.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("block", "part")))["part"], "").alias("children"), F.sum("below").alias("below"))
            level = level.join(below, ["doc_id", "node_id"], "left")
        else:
            level = level.withColumns({"children": F.lit(""), "below": F.lit(0).cast("long")})
        digest = F.sha2(F.concat_ws(_PART, "own", F.coalesce("children", F.lit(""))), 256)
        levels.append(written(level.select("doc_id", "node_id", "parent_id", "ord", digest.alias("digest"), (F.coalesce("below", F.lit(0)) + 1).alias("nodes")), "digests"))
    return reduce(DataFrame.unionByName, levels).select("doc_id", "node_id", "digest", "nodes")
