"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

* Every source gets a target: its weight's share of the budget, at most
  ``max_epochs`` times its size, the excess reshared by weight (water filling over
  one row for each source).
* Each source's documents are shuffled anew for each epoch (ordered by a hash) and
  laid end to end; the stream is cut into blocks of equal tokens.
* A schedule of slots is drawn from the van der Corput sequence: slot ``n``'s point
  is ``n`` with its bits reversed, mapped through the cumulative weights to a source,
  and the slots of a source are ranked.  Slot rank ``r`` of a source plays its block ``r``.

Running totals over a source that holds a third of all rows never meet in one task:
documents are summed in hash buckets, the bucket totals are added up, and only then
is each bucket ordered.  Slots are ranked in runs in the same way.

Defined results: null and blank texts have size 0 and are never taken; a null source
is a source of its own, the last; a null ``doc_id`` is a document; repeated rows are
documents each, and rows that tie in id, source and size are told apart by number alone; very
long texts lie in as many blocks as they fill; no rows give no rows; extra columns are unused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import documents, materialise, word_count

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
BLOCK_TOKENS = 1024
#: Hex digits of the shuffle hash that name a bucket: 4,096 buckets for each source and epoch.
BUCKET_DIGITS = 3
SLOT_RUN = 1 << 16


def sized_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, copy``: copy tells rows that agree in all three apart."""
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"))
    same = Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(0))
    return materialise(sized.withColumn("copy", F.row_number().over(same).cast("long")), "sized")


def source_targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row for each source: ``source, idx, source_size, target, quota`` (whole tokens)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # windows without a key: their rows are sources, not documents
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int"))
    named = totals.withColumn("idx", F.row_number().over(by_name).cast("long") - 1).withColumn("weight", weight.cast("double"))
    by_room = Window.orderBy("room", "idx")
    filled = (
        named.withColumn("cap", max_epochs * F.col("source_size").cast("double"))
        .withColumn("room", F.col("cap") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("level", (F.lit(budget) * F.col("total") - F.col("before")) / F.col("rest"))
    )
    level = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "idx", "level"))).over(Window.partitionBy())["level"]
    target = F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return filled.withColumn("target", target).select("source", "idx", "source_size", "target", F.floor("target").cast("long").alias("quota"))


def block_pieces(sized: DataFrame, targets: DataFrame, block: int, epochs: int) -> DataFrame:
    """Parts of documents in the blocks of their source's stream: ``idx, block, at, doc_id, size, copy, epoch, skip, n``."""
    key = F.md5(F.concat(F.lit("mix:"), F.col("epoch").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = (
        sized.where("size > 0")
        .join(targets.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .where(F.col("epoch") * F.col("source_size") < F.col("quota"))
        .withColumn("key", key)
        .select("idx", "epoch", F.substring("key", 1, BUCKET_DIGITS).alias("bucket"), "key", "doc_id", "size", "copy", "quota")
    )
    ahead = Window.partitionBy("idx").orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        rows.groupBy("idx", "epoch", "bucket")
        .agg(F.sum("size").alias("n"))
        .select("idx", "epoch", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("idx", "epoch", "bucket").orderBy("key", "doc_id", "size", "copy")
    placed = (
        rows.withColumn("so_far", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(bases, ["idx", "epoch", "bucket"])
        .withColumn("start", F.col("base") + F.col("so_far") - F.col("size"))
        .where("start < quota")
        .withColumn("end", F.least(F.col("start") + F.col("size"), F.col("quota")))
    )
    return (
        placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
        .withColumn("lo", F.greatest("start", F.col("block") * block))
        .withColumn("hi", F.least("end", (F.col("block") + 1) * block))
        .select("idx", "block", (F.col("lo") - F.col("block") * block).alias("at"), "doc_id", "size", "copy", "epoch", (F.col("lo") - F.col("start")).alias("skip"), (F.col("hi") - F.col("lo")).alias("n"))
    )


def slot_schedule(targets: DataFrame, block: int) -> DataFrame:
    """``slot, idx, block``: the first slots of each source, as many as it has blocks.

    The sequence runs to a power of two at least twice the slots needed, where every
    source has been met at least once for each of its blocks."""
    spark = targets.sparkSession
    shares = targets.withColumn("blocks", F.ceil(F.col("quota") / block).cast("long")).where("blocks > 0")
    shares = shares.withColumn("upto", F.sum("blocks").over(Window.orderBy("idx")))
    needed = shares.agg(F.sum("blocks")).first()[0] or 0
    bits = max(1, (2 * needed - 1).bit_length()) if needed else 0
    cell_bits = min(bits, 10)
    scale = float(1 << bits)
    edges = shares.select("idx", "blocks", F.floor((F.col("upto") - F.col("blocks")) / F.lit(float(needed or 1)) * scale).cast("long").alias("lo"), F.floor(F.col("upto") / F.lit(float(needed or 1)) * scale).cast("long").alias("hi"))
    shift = bits - cell_bits
    # a range join as an equi-join on cells of the unit interval
    cells = edges.where("lo < hi").withColumn("cell", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))))
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), max(bits, 1), "0")), 2, 10).cast("long")
    slots = spark.range(0, 1 << bits if needed else 0).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", F.shiftright("point", shift))
    met = slots.join(cells, "cell").where("point >= lo and point < hi").select("slot", "idx", "blocks", F.floor(F.col("slot") / SLOT_RUN).alias("run"))
    ahead = Window.partitionBy("idx").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = met.groupBy("idx", "run").agg(F.count(F.lit(1)).alias("k")).select("idx", "run", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("base"))
    ranked = met.withColumn("rn", F.row_number().over(Window.partitionBy("idx", "run").orderBy("slot"))).join(bases, ["idx", "run"])
    return ranked.withColumn("block", F.col("base") + F.col("rn") - 1).where("block < blocks").select("slot", "idx", "block")


def mix(sized: DataFrame, targets: DataFrame, block: int = BLOCK_TOKENS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed stream: ``slot, at`` (order), ``idx, doc_id, size, copy, epoch, skip, n``."""
    return slot_schedule(targets, block).join(block_pieces(sized, targets, block, max_epochs), ["idx", "block"])


def taken_by_document(docs: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each document, with the tokens that the mix takes of it, and the slot of the
    schedule (and the place in its block) at which the mix first plays it."""
    sized = sized_documents(docs)
    targets = materialise(source_targets(sized), "targets")
    taken = mix(sized, targets, block).select("idx", "doc_id", "size", "copy", F.col("n").alias("taken"), F.struct("slot", "at", "epoch").alias("place"))
    named = targets.withColumnRenamed("source", "named")
    rest = sized.join(named, F.col("source").eqNullSafe(F.col("named"))).select("idx", "doc_id", "size", "copy", F.lit(0).cast("long").alias("taken"), F.lit(None).cast(taken.schema["place"].dataType).alias("place"))
    total = taken.unionByName(rest).groupBy("idx", "doc_id", "size", "copy").agg(F.sum("taken").alias("taken"), F.min("place").alias("place"))
    return total.join(targets, "idx").withColumns({"first_slot": F.col("place.slot"), "first_at": F.col("place.at")}).drop("place")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_by_document(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "first_at")


OP1_SQL = r"""
WITH counted AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sized AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS copy FROM counted
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), named AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM totals
), weighed AS (
  SELECT *, CAST(CASE idx % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM named
), filled AS (
  SELECT *, cap / weight AS room,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY cap / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM weighed
), leveled AS (
  SELECT *, (1.5::DOUBLE * total - before) / rest AS level FROM filled
), targets AS (
  SELECT source, idx, source_size,
    least(cap, (SELECT arg_min(level, (room, idx)) FROM leveled WHERE level <= room) * weight) AS target
  FROM leveled
), stream AS (
  SELECT s.doc_id, s.source, s.size, s.copy, t.idx, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS quota, e.epoch,
    md5('mix:' || e.epoch || ':' || coalesce(CAST(s.doc_id AS VARCHAR), '')) AS key
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) e(epoch)
), placed AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY idx ORDER BY epoch, key, doc_id, size, copy ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start FROM stream
), blocks AS (
  SELECT idx, CAST(ceil(floor(target) / 1024.0::DOUBLE) AS BIGINT) AS blocks FROM targets WHERE floor(target) > 0
), upto AS (
  SELECT idx, blocks, sum(blocks) OVER (ORDER BY idx) AS upto, sum(blocks) OVER ()::DOUBLE AS needed FROM blocks
), width AS (
  SELECT CAST(ceil(log2(2 * max(needed))) AS BIGINT) AS bits FROM upto
), edges AS (
  SELECT idx, blocks, floor((upto - blocks) / needed * pow(2, bits)) AS lo, floor(upto / needed * pow(2, bits)) AS hi FROM upto, width
), slots AS (
  SELECT slot, list_sum(list_transform(range(0, bits), lambda i: ((slot >> i) & 1) << (bits - 1 - i))) AS point
  FROM (SELECT bits, unnest(range(0, CAST(pow(2, bits) AS BIGINT))) AS slot FROM width)
), schedule AS (
  SELECT slot, idx, block FROM (SELECT slot, idx, blocks, row_number() OVER (PARTITION BY idx ORDER BY slot) - 1 AS block FROM slots JOIN edges ON point >= lo AND point < hi) WHERE block < blocks
), pieces AS (
  SELECT *, least(start + size, quota) AS stop, unnest(range(CAST(floor(start / 1024) AS BIGINT), CAST(floor((least(start + size, quota) - 1) / 1024) AS BIGINT) + 1)) AS block FROM placed WHERE size > 0 AND start < quota
), played AS (
  SELECT doc_id, copy, p.idx, size, min({'slot': slot, 'at': CAST(greatest(start, block * 1024) - block * 1024 AS BIGINT)}) AS place FROM pieces p JOIN schedule USING (idx, block) GROUP BY ALL
), summed AS (
  SELECT doc_id, copy, idx, size, source_size, target, CAST(sum(greatest(0, least(start + size, quota) - start)) AS BIGINT) AS taken
  FROM placed GROUP BY ALL
)
SELECT s.doc_id, s.size, source_size, target, taken, place.slot AS first_slot, place.at AS first_at
FROM summed s LEFT JOIN played p ON s.doc_id IS NOT DISTINCT FROM p.doc_id AND s.copy = p.copy AND s.idx = p.idx AND s.size = p.size
"""
