"""A corpus pipeline of five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``.

1. toxicity: documents that the grammar rejects go.
2. exact_dedup: of equal texts the owner stays.
3. near_dedup: of each component of similar documents the smallest id stays.
4. mixing: each document appears as often as the mix takes it; the one that a
   source's target cuts appears up to the end of its last word taken; untaken ones go.
5. packing: the mixed documents' token pieces in sequences of 4,096.

Defined results: a stage that drops documents goes by id and text, so rows that share a
``doc_id`` are told apart unless they tie in both; null texts are empty (kept until mixing,
which takes no word of them); very long texts stay whole until packing cuts them; empty
tables give empty tables; extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import BLANKS, documents, materialise, tokenizer_path, word_count, words_of
from quarrymill.llm.common import labels as label_table
from quarrymill.llm.exact_dedup import exact_dedup
from quarrymill.llm.mixing import taken_by_document
from quarrymill.llm.packing import VOCABULARY, pack, tokenised_pieces
from quarrymill.llm.shingle_join import similar_components
from quarrymill.llm.toxicity import clean_rows, learn


def _only(docs: DataFrame, kept: DataFrame, digest: Column) -> DataFrame:
    """The rows of ``docs`` whose id and text are among ``kept`` (``doc_id, digest``; null ids
    compare equal)."""
    marks = kept.select(F.struct(F.col("doc_id").alias("i"), F.col("digest").alias("d")).alias("kept_row"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct(docs["doc_id"].cast("long").alias("i"), digest.alias("d")).alias("own"))
    return rows.join(marks, F.col("own").eqNullSafe(F.col("kept_row")), "left_semi").select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_rows(docs, *learn(docs, label_table(spark, sf_dir)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = exact_dedup(docs).where("kept").select("doc_id", F.col("text_sha256").alias("digest"))
    bare = F.translate(F.coalesce(docs["text"].cast("string"), F.lit("")), BLANKS, "")
    return _only(docs, found, F.sha2(bare.cast("binary"), 256))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a set of shingles are in no group and stay."""
    found = similar_components(docs).where("doc_id <=> component_id").select("doc_id", F.lower(F.hex("key")).alias("digest"))
    return _only(docs, found, F.substring(F.sha2(docs["text"].cast("binary"), 256), 1, 32))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, and the one that the mix cuts up to
    the end of its last word taken, line ends and all."""
    taken = taken_by_document(docs).where("taken > 0").groupBy("doc_id", "size").agg(F.max("taken").alias("taken"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), word_count(F.col("text")).alias("words"))
    joined = rows.join(taken.hint("merge"), rows["id"].eqNullSafe(taken["doc_id"]) & (rows["words"] == taken["size"]))
    whole, rest = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    each = joined.withColumn("cut", F.explode(copies))
    text = F.when(F.col("cut") > 0, first_words(F.col("row.text"), F.col("cut"))).otherwise(F.col("row.text"))
    columns = [text.alias(c) if c == "text" else F.char_length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return each.select(*columns)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    blanks = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]+)"), F.lit(1))
    words = words_of(text)
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    parts = F.transform(F.slice(words, F.lit(1), n.cast("int")), lambda w, i: F.concat(F.when((i + lead) > 0, F.get(blanks, (i + lead - 1).cast("int"))).otherwise(F.lit("")), w))
    return F.array_join(parts, "")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(tokenised_pieces(docs, tokenizer_path(VOCABULARY)))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: Toxicity and similarity cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
