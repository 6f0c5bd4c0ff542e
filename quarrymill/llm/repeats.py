"""Substring deduplication with prefix-partitioned suffix trees.

A word goes when a window of ``WINDOW`` words that covers it also starts in a document
with a smaller id.  Such windows are the suffixes that stand in the suffix tree of the
corpus under a node at that depth with a smaller document below it.

* Only suffixes that can have such a node enter.  Of the corpus' runs of ``GRAM`` words
  those are counted whose own hash is drawn (one in ``DRAWN``, alike wherever a run
  stands); a window that holds a drawn run of one document only is repeated nowhere.
  Exact copies enter once.
* Suffixes are split by prefixes of varying length: a suffix is read up to the end of the run
  of its first ``WINDOW`` words that has the smallest hash, 8 to 50 words.  Equal windows have equal
  prefixes.  Prefixes that end in the same run make a group, because consecutive suffixes have such
  prefixes and then travel as one piece of text.
* A group of up to ``GROUP_BYTES`` is solved in memory, several small ones together: a linked suffix
  tree of its pieces (``suffix_tree``), in which each suffix finds the deepest node above it with a
  smaller document below; the node's label is a maximal repeat, and gives a run of windows.
* For a larger group the prefix is lengthened to the whole window.  Its equal pieces are first made
  one, with their smallest document, by an aggregation that combines before it shuffles; then
  equal windows meet by their text, and each piece is told the smallest document of each of its windows.

Defined results: null and blank texts have no words; a null ``doc_id`` is never smaller
and never loses words; rows that repeat an id are not smaller than each other, so ties
lose nothing; very long and periodic texts are cut into pieces of ``PIECE`` windows, each
whole, and groups by bytes, so long words do not make one heavy; no rows give no rows; extra
columns are unused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import dispose, documents, materialise
from quarrymill.llm.hashing import run_hashes, sliding_min, word_hashes
from quarrymill.llm.suffix_tree import repeated_runs
from quarrymill.llm.tokenisation import text_chunks

WINDOW = 50
GRAM = 8
DRAWN = 8
PIECE = 1 << 10
#: Bytes of pieces that are one group at most, and of small groups that are solved together.
GROUP_BYTES, SOLVED_BYTES = 2 << 20, 1 << 19
#: Bytes of text hashed at once; numpy holds some 80 times as many.
_CHUNK_BYTES = 1 << 19


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.append(0, np.cumsum([p.size for p in parts])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64()))


def _gram(window: int) -> int:
    return min(GRAM, window)


def gram_table(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, rid, whole, grams, bare`` of every document with a window: its distinct drawn
    runs, and whether a window holds none of them."""
    gram = _gram(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", _CHUNK_BYTES):
            words, cuts = word_hashes(batch.column("text"))
            runs = run_hashes(words[0], gram)
            keep, whole, found, bare = [], [], [], []
            for i in range(batch.num_rows):
                lo, hi = int(cuts[i]), int(cuts[i + 1])
                if hi - lo >= window:
                    own = runs[lo : hi - gram + 1]
                    at = np.flatnonzero(own % DRAWN == 0)
                    keep.append(i)
                    found.append(np.unique(own[at]).view(np.int64))
                    bare.append(bool((np.diff(np.concatenate(([-1], at, [own.size]))) > window - gram + 1).any()))
                    whole.append(hashlib.blake2b(np.ascontiguousarray(words[:, lo:hi]).tobytes(), digest_size=16).digest())
            part = batch.take(pa.array(keep, pa.int64()))
            yield _rows(doc_id=part.column("doc_id"), tkey=part.column("tkey"), rid=part.column("rid"), whole=pa.array(whole, pa.binary()), grams=_lists(found), bare=pa.array(bare, pa.bool_()))

    return docs.mapInArrow(run, "doc_id long, tkey long, rid long, whole binary, grams array<long>, bare boolean")


def suffixes(docs: DataFrame, window: int) -> DataFrame:
    """Consecutive suffixes of one group, as text: ``key, doc_id, tkey, start, n, body``.
    ``grams`` lists the drawn runs of a document that another has, too."""
    gram = _gram(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", _CHUNK_BYTES):
            words, cuts = word_hashes(batch.column("text"))
            runs = run_hashes(words[0], gram)
            least = sliding_min(runs, window - gram + 1).view(np.int64)
            row, key, start, size, body = [], [], [], [], []
            for i, (text, shared) in enumerate(zip(batch.column("text").to_pylist(), batch.column("grams").to_pylist(), strict=True)):
                lo, hi = int(cuts[i]), int(cuts[i + 1])
                n = hi - lo - window + 1
                if n <= 0:
                    continue
                own = runs[lo : hi - gram + 1]
                lone = (own % DRAWN == 0) & ~np.isin(own.view(np.int64), np.array(shared, dtype=np.int64))
                sums = np.append(0, np.cumsum(lone))
                can = sums[window - gram + 1 :] == sums[:n]
                if not can.any():
                    continue
                keys = least[lo : lo + n]
                turn = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (can[1:] != can[:-1])))
                stop = np.append(turn[1:], n)
                parts = text.split()
                for s, e in zip(turn[can[turn]].tolist(), stop[can[turn]].tolist(), strict=True):
                    for p in range(s, e, PIECE):
                        q = min(p + PIECE, e)
                        row.append(i)
                        key.append(int(keys[p]))
                        start.append(p)
                        size.append(q - p)
                        body.append(b" ".join(parts[p : q + window - 1]))
            part = batch.take(pa.array(row, pa.int64()))
            yield _rows(key=pa.array(key, pa.int64()), doc_id=part.column("doc_id"), tkey=part.column("tkey"), start=pa.array(start, pa.int64()), n=pa.array(size, pa.int64()), body=pa.array(body, pa.binary()))

    return docs.mapInArrow(run, "key long, doc_id long, tkey long, start long, n long, body binary")


_RUN = "doc_id long, tkey long, start long, n long"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return _rows(**{name: pa.array(column, pa.int64()) for name, column in zip(("doc_id", "tkey", "start", "n"), zip(*rows, strict=True), strict=True)})


def subtrees(window: int):
    """Over pieces ordered by group: runs of windows that a smaller document has, too."""

    def solve(pieces: list[tuple]) -> list[tuple]:
        found = repeated_runs([p[5].split(b" ") for p in pieces], [p[1] for p in pieces], window)
        return [(pieces[k][1], pieces[k][2], pieces[k][3] + start, n) for k, start, n in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for piece in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "tkey", "start", "n", "body")), strict=True):
                if piece[0] != last and size >= SOLVED_BYTES:
                    if rows := solve(held):
                        yield _packed(rows)
                    held, size = [], 0
                last = piece[0]
                held.append(piece)
                size += len(piece[5])
        if held and (rows := solve(held)):
            yield _packed(rows)

    return run


def whole_windows(window: int):
    """Each different window of a piece, as its text, and where it stands there: ``node, bid, ats, least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bid, n, least, body in zip(*(batch.column(c).to_pylist() for c in ("bid", "n", "least", "body")), strict=True):
                cuts = np.append(0, np.cumsum([len(w) + 1 for w in body.split(b" ")])).tolist()
                places: dict[bytes, list[int]] = {}
                for i in range(n):
                    places.setdefault(body[cuts[i] : cuts[i + window] - 1], []).append(i)
                yield _rows(node=pa.array(list(places), pa.binary()), bid=pa.array([bid] * len(places), pa.int64()), ats=pa.array(list(places.values()), pa.list_(pa.int64())), least=pa.array([least] * len(places), pa.int64()))

    return run


def told_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows of a piece whose smallest document (``firsts``, in order) is smaller than its own."""
    for batch in batches:
        out = []
        for doc_id, tkey, start, firsts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tkey", "start", "firsts")), strict=True):
            gone = np.concatenate(([False], np.array(firsts, np.int64) < doc_id, [False]))
            turns = np.flatnonzero(gone[1:] != gone[:-1])
            out += [(doc_id, tkey, start + lo, hi - lo) for lo, hi in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]
        if out:
            yield _packed(out)


def large_groups(pieces: DataFrame, window: int) -> DataFrame:
    """Runs of windows of the pieces of groups that no task could hold."""
    bodies = pieces.groupBy("key", "body").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"))
    bodies = materialise(bodies.withColumn("bid", F.monotonically_increasing_id()), "bodies")
    windows = bodies.select("bid", "n", "least", "body").mapInArrow(whole_windows(window), "node binary, bid long, ats array<long>, least long")
    windows = materialise(windows, "windows")
    first = windows.groupBy("node").agg(F.min("least").alias("first"))
    told = windows.join(first.hint("merge"), "node").groupBy("bid").agg(F.collect_list(F.struct("ats", "first")).alias("f"))  # as many as a piece has windows
    each = F.flatten(F.transform("f", lambda x: F.transform(x["ats"], lambda at: F.named_struct(F.lit("at"), at, F.lit("first"), x["first"]))))
    told = told.select("bid", F.array_sort(each)["first"].alias("firsts")).join(bodies.select("bid", "key", "body"), "bid")
    met = pieces.join(told.hint("merge"), ["key", "body"]).select("doc_id", "tkey", "start", "firsts")
    return met.mapInArrow(told_runs, _RUN)


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Runs of windows to remove (``doc_id, tkey, start, n``), and exact copies (``doc_id, tkey``)."""
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("rid", F.xxhash64("doc_id", "text"))
    table = materialise(gram_table(known, window), "grams")
    # written, so that a text with very many copies meets it in a join, which can be split
    firsts = materialise(table.groupBy("whole").agg(F.min(F.struct("doc_id", "tkey", "rid")).alias("first")).select("whole", "first.*"), "firsts")
    copies = table.select("doc_id", "tkey", "whole").join(firsts.select("whole", F.col("doc_id").alias("first_id")), "whole").where("doc_id > first_id").select("doc_id", "tkey")
    alone = table.join(firsts.select("doc_id", "tkey", "rid"), ["doc_id", "tkey", "rid"], "left_semi")
    # ``rid`` only brings a document's runs together: two documents under one get more candidates, no other result
    spread = alone.select("rid", F.explode("grams").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    kept = spread.join(shared.hint("merge"), "key").groupBy("rid").agg(F.collect_list("key").alias("grams"))
    marks = kept.unionByName(alone.where("bare").select("rid", F.array().cast("array<long>").alias("grams"))).groupBy("rid").agg(F.flatten(F.collect_list("grams")).alias("grams"))
    found = materialise(suffixes(known.join(marks, "rid"), window), "suffixes")
    # a group of one document holds no repeat
    groups = found.groupBy("key").agg(F.sum(F.length("body")).alias("bytes"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    groups = materialise(groups.select("key", (F.col("bytes") > GROUP_BYTES).alias("large")), "groups")
    columns = ("key", "doc_id", "tkey", "start", "n", "body")
    small = found.join(groups.where("NOT large").hint("merge"), "key").select(*columns)
    solved = small.repartition("key").sortWithinPartitions("key").mapInArrow(subtrees(window), _RUN)
    large = found.join(groups.where("large"), "key").select(*columns)
    solved = materialise(solved.unionByName(large_groups(large, window)), "repeats")
    dispose(found, groups)
    return solved, copies


def keyed(docs: DataFrame) -> DataFrame:
    """``tkey`` tells apart rows that share a ``doc_id``: 63 bits of the text's SHA-256."""
    return docs.select(F.col("doc_id").cast("long"), F.conv(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 15), 16, 10).cast("long").alias("tkey"), F.col("text").cast("binary").alias("text"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` of every document."""
    docs = keyed(docs)
    gone, copies = repeated_windows(docs, window)
    cuts = gone.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", "tkey", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("n"), F.lit(True).alias("copy")))
    cuts = cuts.groupBy("doc_id", "tkey").agg(F.collect_list(F.when(~F.col("copy"), F.struct("start", "n"))).alias("runs"), F.bool_or("copy").alias("copy"))
    # starts and lengths in turn
    cuts = cuts.select("doc_id", "tkey", "copy", F.flatten(F.transform("runs", lambda x: F.array(x["start"], x["n"]))).alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", _CHUNK_BYTES):
            n_words, n_removed, sha, kept_texts = [], [], [], []
            for text, starts, copy in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "copy")), strict=True):
                words = (text or b"").split()  # bytes.split parts at exactly the six blanks
                if copy:
                    kept = []
                elif starts:
                    depth = np.zeros(len(words) + 1, dtype=np.int64)
                    at, n = np.array(starts, dtype=np.int64).reshape(-1, 2).T
                    np.add.at(depth, at, 1)
                    np.add.at(depth, at + n + window - 1, -1)
                    stay = np.cumsum(depth[:-1]) == 0
                    kept = [words[i] for i in np.flatnonzero(stay).tolist()]
                else:
                    kept = words
                body = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(body).hexdigest())
                kept_texts.append(body)
            yield _rows(doc_id=batch.column("doc_id"), n_words=pa.array(n_words, pa.int64()), n_removed=pa.array(n_removed, pa.int64()), kept_sha256=pa.array(sha, pa.string()), kept_text=pa.array(kept_texts, pa.binary()))

    joined = docs.join(cuts, ["doc_id", "tkey"], "left").select("doc_id", "text", "starts", "copy")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text binary")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept_text")
