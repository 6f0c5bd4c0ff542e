"""Exact deduplication with Patricia-trie owners.

Texts are equal when their bytes are, once blanks are deleted.  Distinct texts are
partitioned by length and content hash; the owner of a partition inserts the full
byte strings into a compressed radix trie whose terminal nodes hold the row that
stays (most code points, then smallest id) and the number of rows.

A text that a third of all rows share is inserted in each input partition first, so
at most one byte string for each distinct text and partition is shuffled.  Both
tries give up memory by subtree.  The combiner hands on its largest subtree when its strings
exceed ``TRIE_BYTES`` (a text may then be sent twice, which the owner merges).  An owner reads
its partition in order of the strings (Spark's sort spills to disk), so whatever branches
off before the path of the string at hand is finished: beyond ``TRIE_BYTES`` these
subtrees are handed on, and the path alone stays.

Rows then meet their groups by the SHA-256 that the result carries anyway.

Defined results: null counts as the empty text, and all empty texts are one group;
a null ``doc_id`` stays only when its group has no other id of as many code points;
repeated rows are counted each, and where two rows of one text share the id that stays, both
are marked as kept, since nothing tells them apart; a text is held whole, however long, and
batches are cut by size; no rows give no rows; extra columns are unused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import BLANK_BYTES, BLANKS, documents
from quarrymill.llm.tokenisation import text_chunks

TRIE_BYTES = 64 << 20
PARTIAL = "size long, hash binary, sha binary, body binary, n_chars long, doc_id long, rows long"


class Trie:
    """Compressed radix trie over byte strings.  A node is
    ``[edge, children by first byte, terminal]``; a terminal is
    ``[n_chars, doc_id, rows]`` of the row that stays and the rows so far."""

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.bytes = 0

    def insert(self, key: bytes, n_chars: int, doc_id: int | None, rows: int) -> bool:
        """True if the key is new."""
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, [n_chars, doc_id, rows]]
                self.bytes += len(key) - at + 200
                return True
            edge = child[0]
            if not key.startswith(edge, at):
                cut = _common(edge, key, at)
                upper = [edge[:cut], {edge[cut]: child}, None]
                child[0] = edge[cut:]
                node[1][key[at]] = upper
                self.bytes += 200
                child = upper
            at += len(child[0])
            node = child
        new = node[2] is None
        if new:
            node[2] = [n_chars, doc_id, rows]
            self.bytes += 100
        else:
            better(node[2], n_chars, doc_id)
            node[2][2] += rows
        return new

    def drain(self, first: int | None = None) -> Iterator[tuple[bytes, list]]:
        """Terminals with their full strings, of one subtree or of all; they leave the trie."""
        if first is None:
            tops, self.root, self.bytes = [(b"", self.root)], [b"", {}, None], 0
        else:
            node = self.root[1].pop(first)
            tops = [(b"", node)]
        while tops:
            above, node = tops.pop()
            full = above + node[0]
            if first is not None:
                self.bytes -= len(node[0]) + 200
            if node[2] is not None:
                yield full, node[2]
            tops += [(full, child) for child in node[1].values()]

    def largest(self) -> int:
        return max(self.root[1], key=lambda b: len(self.root[1][b][1]) * 1000 + len(self.root[1][b][0]))

    def finished(self, key: bytes) -> Iterator[tuple[bytes, list]]:
        """Terminals of the subtrees before ``key`` in order; they leave the trie."""
        node, at = self.root, 0
        while True:
            following = key[at] if at < len(key) else 256
            for first in [b for b in node[1] if b < following]:
                above, tops = key[:at], [(key[:at], node[1].pop(first))]
                while tops:
                    above, top = tops.pop()
                    full = above + top[0]
                    self.bytes -= len(top[0]) + 200
                    if top[2] is not None:
                        yield full, top[2]
                    tops += [(full, child) for child in top[1].values()]
            child = node[1].get(following)
            if child is None or not key.startswith(child[0], at):
                return
            at += len(child[0])
            node = child


def better(kept: list, n_chars: int, doc_id: int | None) -> None:
    if n_chars > kept[0] or n_chars == kept[0] and doc_id is not None and (kept[1] is None or doc_id < kept[1]):
        kept[0], kept[1] = n_chars, doc_id


def _common(edge: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of edge and key[at:], known to differ."""
    low, high = 0, min(len(edge), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key.startswith(edge[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in PARTIAL.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _packed(found: Iterator[tuple[bytes, list]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for body, (n_chars, doc_id, count) in found:
        sha = hashlib.sha256(body).digest()
        rows.append((len(body), sha[:8], sha, body, n_chars, doc_id, count))
        held += len(body)
        if held > most:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct texts of an input partition."""
    trie = Trie()
    for batch in text_chunks(batches, "text"):
        for doc_id, text, n_chars in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "n_chars")), strict=True):
            trie.insert((text or b"").translate(None, BLANK_BYTES), n_chars, doc_id, 1)
            while trie.bytes > TRIE_BYTES and trie.root[1]:
                yield from _packed(trie.drain(trie.largest()))
    yield from _packed(trie.drain())


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of a partition that is ordered by its strings."""
    trie = Trie()
    for batch in text_chunks(batches, "body"):
        for body, n_chars, doc_id, rows in zip(*(batch.column(c).to_pylist() for c in ("body", "n_chars", "doc_id", "rows")), strict=True):
            if trie.bytes > TRIE_BYTES:
                yield from _hashed(trie.finished(body))
            trie.insert(body, n_chars, doc_id, rows)
    yield from _hashed(trie.drain())


def _hashed(found: Iterator[tuple[bytes, list]], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    rows = []
    for body, (_, doc_id, count) in found:
        rows.append((hashlib.sha256(body).digest(), doc_id, count))
        if len(rows) >= most:
            yield _groups(rows)
            rows = []
    if rows:
        yield _groups(rows)


def _groups(rows: list[tuple]) -> pa.RecordBatch:
    sha, keep, size = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), pa.array(keep, pa.int64()), pa.array(size, pa.int64())], ["sha", "keep_id", "group_size"])


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row for each distinct text: ``sha, keep_id, group_size``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))
    partial = rows.mapInArrow(combine, PARTIAL).drop("sha")
    return partial.repartition(F.col("size"), F.col("hash")).sortWithinPartitions("body").mapInArrow(own, "sha binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row.

    The rows meet their groups by digest in a sort-merge join, whose large partitions
    Spark splits; a row there is an id and a digest."""
    bare = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), BLANKS, "")
    rows = docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(bare.cast("binary"), 256)).alias("sha"))
    joined = rows.join(exact_groups(docs).hint("merge"), "sha")
    return joined.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP2_SQL = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), grouped AS (
  SELECT doc_id, text_sha256,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM bare
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM grouped
"""
