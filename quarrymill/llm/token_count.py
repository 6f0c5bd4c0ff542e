"""Token counts by rank-synchronous merging of ragged numpy arrays.

A text is cut at white space (no pre-token of the vocabulary crosses it), each
new distinct pre-token joins a batch, and the batch is merged together: one flat
symbol array, one sequence number for each symbol; every round finds each
sequence's lowest-rank adjacent pair with one sorted lookup and one segmented
minimum and merges it in all sequences at once, until no pair is left.  The count
is what survives.

A pair whose merged symbol could form a pair of a still lower rank is merged at
its leftmost place only in a round; for all others every non-overlapping place,
left to right, gives what one-at-a-time merging gives.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
are counted row by row; a null ``doc_id`` stays null; other columns are unused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import documents, tokenizer_path
from quarrymill.llm.tokenisation import PieceTable, row_sums, text_chunks

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def count_tokens(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(path)
        for batch in text_chunks(batches, "text"):
            cuts, codes, _, counts = table.code(batch.column("text"))
            n = row_sums(counts[codes], cuts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), tokenizer_path(VOCABULARY))
