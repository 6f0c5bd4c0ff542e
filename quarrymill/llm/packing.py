"""Best-fit packing of token sequences by large-item matching.

Lengths are whole numbers up to the capacity, so the packing problem of any
corpus is its histogram of lengths: at most ``capacity`` numbers, whatever the
corpus size.  The driver solves it on counts (``plan_bins``):

* pieces of the full capacity are bins of their own;
* pieces above a third of the capacity fit at most twice in a bin: they are
  matched greedily, the longest left with the longest that still fits beside it;
* the smaller ones go, longest first, each into the bin with the least room that
  still takes it, and into new bins when none does.

The plan says, for each length and each range of ranks, which bins and which
offset these pieces get.  Pieces are ranked within their length in hash buckets
(a length that a third of all rows share is spread over all buckets), and the
plan's lookup tables, bounded by the capacity, go to the workers.

Defined results: null and empty texts are the end token alone (length 1); a null
``doc_id`` stays null; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import documents, materialise, tokenizer_path
from quarrymill.llm.tokenisation import PieceTable, gather, row_sums, text_chunks

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
#: Pieces ranked together; the number of hash buckets grows with the pieces.
BUCKET_ROWS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = PieceTable(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in text_chunks(batches, "text"):
            cuts, codes, flat, counts = table.code(batch.column("text"))
            size = row_sums(counts[codes], cuts)
            raw, at = gather(codes, flat, counts).astype("<u4").tobytes(), np.append(0, np.cumsum(size)).tolist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for row, doc in enumerate(batch.column("doc_id").to_pylist()):
                ids = raw[4 * at[row] : 4 * at[row + 1]] + end
                total = len(ids) // 4
                for k, start in enumerate(range(0, total, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for column, value in zip(out, (doc, k, start, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, first_rank, count, first_bin, offset)``: the pieces of that
    length with ranks ``first_rank .. first_rank + count - 1`` go, one each, to the
    bins from ``first_bin`` on, at ``offset``.  Bins are whole and numbered from 0."""
    left = {n: c for n, c in histogram.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    bins = 0
    rows: list[tuple[int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first bin, bins)]
    order: list[int] = []  # rooms that have bins, ascending

    def put(length: int, count: int, first_bin: int, offset: int) -> None:
        rows.append((length, used[length], count, first_bin, offset))
        used[length] += count
        left[length] -= count

    def leave(room: int, first_bin: int, count: int) -> None:
        if room <= 0:
            return
        if not rooms[room]:
            bisect.insort(order, room)
        rooms[room].append((first_bin, count))

    if left.get(capacity):
        n = left[capacity]
        put(capacity, n, bins, 0)
        bins += n
    large = sorted(n for n in left if capacity > n > capacity // 3)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - a) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        if at < 0:
            n = left[a]
            put(a, n, bins, 0)
            leave(capacity - a, bins, n)
        else:
            b = large[at]
            n = min(left[a], left[b]) if a != b else left[a] // 2
            if n == 0:  # a single one of its length is left: its partner must be shorter
                shorter = [x for x in large[:at] if left[x]]
                if shorter:
                    b, n = shorter[-1], 1
            if n == 0:
                n = left[a]
                put(a, n, bins, 0)
                leave(capacity - a, bins, n)
            else:
                put(a, n, bins, 0)
                put(b, n, bins, a)
                leave(capacity - a - b, bins, n)
        bins += n
    for s in sorted((n for n in left if n <= capacity // 3), reverse=True):
        while left[s]:
            at = bisect.bisect_left(order, s)
            if at == len(order):
                each = capacity // s
                full, rest = divmod(left[s], each)
                room, first, count, each = (capacity, bins, full, each) if full else (capacity, bins, 1, rest)
                bins += count
            else:
                room = order[at]
                first, have = rooms[room].pop()
                if not rooms[room]:
                    order.pop(at)
                each = room // s
                full, rest = divmod(left[s], each)
                count, each = (min(full, have), each) if full else (1, rest)
                if count < have:
                    leave(room, first + count, have - count)
            for k in range(each):
                put(s, count, first, capacity - room + k * s)
            leave(room - each * s, first, count)
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32), with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = materialise(pieces, "pieces")
    buckets = max(1, -(-pieces.count() // bucket_rows))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    per_bucket = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # at most capacity x buckets rows; each length's running total over its buckets
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_bucket.select("length", "bucket", "n", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = sorted(plan_bins(histogram, capacity))
    keys = np.array([(n << 48) + first for n, first, *_ in plan], dtype=np.int64)
    at_bin = np.array([b - first for _, first, _, b, _ in plan], dtype=np.int64)
    at_offset = np.array([o for *_, o in plan], dtype=np.int64)
    shared = spark.sparkContext.broadcast((keys, at_bin, at_offset))  # bounded by the capacity, not by the rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, at_bin, at_offset = shared.value
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << 48) + rank, side="right") - 1
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(at_bin[at] + rank, pa.int64()), pa.array(at_offset[at], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        dealt.withColumn("rn", F.row_number().over(within))
        .join(offsets.select("length", "bucket", "before"), ["length", "bucket"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rn") - 1).alias("rank"))
    )
    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tokenised_pieces(documents(spark, sf_dir), tokenizer_path(VOCABULARY)))
