"""Text normal forms, grams, TF-IDF, similarity, vectors and markup."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.functions import numeric, text
from quarrymill.operators import similarity as sim
from quarrymill.plans.registry import Family
from quarrymill.scratch import written
from quarrymill.tables import load

family = Family()

#: Query vectors, and other vectors, that meet in a task.
QUERY_BLOCK, VECTOR_BLOCK = 2_000, 20_000
#: Bit hashes of a label that meet as many others in a group, and those compared at once.
HASH_BLOCK, HASH_STEP = 8_192, 128


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query vector, exactly, in blocks.

    Both tables are dealt in blocks of bounded size, and each block of queries meets each of
    vectors in a task of its own, which keeps k of each query; those are then ranked."""
    import numpy as np
    import pandas as pd

    columns = max(1, -(-queries.count() // QUERY_BLOCK))
    rows = max(1, -(-vectors.count() // VECTOR_BLOCK))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.col("vec_id").alias("id"), F.col("embedding").alias("e"), F.lit(True).alias("asks"), deal(columns, 1).alias("q"), each(rows).alias("v"))
    told = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("e"), F.lit(False).alias("asks"), each(columns).alias("q"), deal(rows, 2).alias("v"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        unit = lambda part: (m := np.array(part["e"].tolist(), dtype=np.float64)) / np.linalg.norm(m, axis=1, keepdims=True)
        ask, tell = group[group["asks"]], group[~group["asks"]]
        out = []
        if len(ask) and len(tell):
            here, ids = unit(tell), tell["id"].to_numpy()
            for lo in range(0, len(ask), 128):
                part = ask.iloc[lo : lo + 128]
                cosine = np.round(np.clip(unit(part) @ here.T, 0, 1), 5)
                for q, row in zip(part["id"], cosine, strict=True):
                    order = np.lexsort((ids, -row))
                    out += [(q, ids[i], row[i]) for i in order[ids[order] != q][:k]]
        return pd.DataFrame(out, columns=["query", "vec_id", "cosine"])

    found = asked.unionByName(told).groupBy("q", "v").applyInPandas(run, "query long, vec_id long, cosine double")
    w = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "vec_id")
    return found.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def similar_hashes(hashes: DataFrame, most: int) -> DataFrame:
    """Pairs ``a, b, distance`` of one label whose bit hashes (64 bits at most) differ in few places, exactly.

    Bands of so few bits part nothing, so all pairs of a label are compared, as machine words: a label's
    vectors are dealt in blocks, each two blocks meet in a group of their own, and a group's pairs leave
    it ``HASH_STEP`` rows at a time."""
    import numpy as np
    import pyarrow as pa

    word = lambda pick: F.aggregate(F.transform("bits", pick), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("long")))
    # a bit that is not known differs from none
    packed = hashes.where("label IS NOT NULL AND vec_id IS NOT NULL AND bits IS NOT NULL").select("vec_id", "label", word(lambda b: F.coalesce(b, F.lit(False))).alias("word"), word(lambda b: b.isNotNull()).alias("known"))
    blocks = packed.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / HASH_BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("vec_id", "word"), F.col("blocks")).cast("int")
    place = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(F.col("own"), k).alias("x"), F.greatest(F.col("own"), k).alias("y")))
    dealt = packed.join(blocks, "label").withColumn("own", own).withColumn("place", F.explode(place)).select("label", "place.*", "own", "vec_id", "word", "known")

    def pairs(rows: list[tuple], x: int, y: int) -> Iterator[pa.RecordBatch]:
        own, ids, words, known = (np.array(c) for c in zip(*rows, strict=True))
        words, known = words.view(np.uint64), known.view(np.uint64)
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        for lo in range(0, left.size, HASH_STEP):
            p = left[lo : lo + HASH_STEP]
            apart = np.bitwise_count((words[p][:, None] ^ words[right][None]) & known[p][:, None] & known[right][None])
            i, j = np.nonzero(apart <= most)
            n = apart[i, j].astype(np.int64)
            a, b = ids[p[i]], ids[right[j]]
            fit = a < b if x == y else a != b  # two of one block meet both ways round
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[fit]), pa.array(np.maximum(a, b)[fit]), pa.array(n[fit])], ["a", "b", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            for label, x, y, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (label, x, y) != at:
                    if len(rows) > 1:
                        yield from pairs(rows, *at[1:])
                    at, rows = (label, x, y), []
                rows.append(tuple(row))
        if len(rows) > 1:
            yield from pairs(rows, *at[1:])

    kind = hashes.schema["vec_id"].dataType.simpleString()
    met = dealt.withColumn("vec_id", F.col("vec_id").cast("long")).repartition("label", "x", "y").sortWithinPartitions("label", "x", "y")
    return met.mapInArrow(run, "a long, b long, distance long").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "distance")


_NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _grams(table: str, key: str) -> str:
    return (
        f"nrm AS (SELECT {key} AS k, string_split({_NORM}, '') AS s, length({_NORM}) AS n FROM {table}), "
        "grams AS (SELECT k, unnest(CASE WHEN n >= 2 THEN list_transform(range(1, len(s)), lambda i: s[i] || s[i + 1]) WHEN n = 1 THEN s ELSE [] END) AS gram FROM nrm), "
        "counts AS (SELECT k, gram, count(*) AS tf FROM grams GROUP BY ALL), "
        f"idf AS (SELECT gram, count(*) AS df, ln((1 + (SELECT count(*) FROM {table})) / (1 + count(*))::DOUBLE) + 1 AS idf FROM counts GROUP BY gram), "
        "raw AS (SELECT k, counts.gram, (1 + ln(tf)) * idf AS x FROM counts JOIN idf USING (gram)), "
        "vec AS (SELECT k, gram, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS w FROM raw)"
    )


def _vectors(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    counts = written(sim.gram_counts(docs, key, "text"), "grams")  # read by the document frequencies and by the weights
    idf = sim.idf_table(counts, docs.agg(F.count(F.lit(1)).alias("docs")))
    return sim.unit_vectors(counts, idf, key), idf


@family.query(f"SELECT doc_id, sha256({_NORM}) AS sha, length({_NORM}) AS n FROM documents")
def text_norm_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.normal(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", text.digest(s).alias("sha"), F.length(s).cast("long").alias("n"))


@family.query(f"WITH {_grams('documents', 'doc_id')} SELECT gram, df, round(idf, 6) AS idf FROM idf")
def bigram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    counts = sim.gram_counts(docs, "doc_id", "text")
    return sim.idf_table(counts, docs.agg(F.count(F.lit(1)).alias("docs"))).select("gram", "df", F.round("idf", 6).alias("idf"))


@family.query(f"WITH {_grams('documents', 'doc_id')} SELECT doc_id, gram, w FROM (SELECT k AS doc_id, gram, round(w, 6) AS w, row_number() OVER (PARTITION BY k ORDER BY round(w, 6) DESC, gram) AS n FROM vec) WHERE n <= 3")
def tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, _ = _vectors(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    w = Window.partitionBy("doc_id").orderBy(F.col("w").desc(), "gram")
    return vectors.withColumn("w", F.round("w", 6)).withColumn("n", F.row_number().over(w)).where("n <= 3").select("doc_id", "gram", "w")


@family.query(f"WITH {_grams('benchmark', 'item_id')} SELECT a.k AS a, b.k AS b, round(sum(a.w * b.w), 6) AS cosine FROM vec a JOIN vec b ON a.gram = b.gram AND a.k < b.k GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.5")
def text_sim_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, _ = _vectors(load(spark, sf_dir, "benchmark"), "item_id")
    return sim.similar_pairs(vectors, "item_id", 0.5).select("a", "b", F.round("cosine", 6).alias("cosine"))


@family.query(
    f"""WITH RECURSIVE {_grams('benchmark', 'item_id')}, near AS (SELECT a.k AS a, b.k AS b FROM vec a JOIN vec b ON a.gram = b.gram AND a.k < b.k GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.8),
ids AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS n FROM benchmark), walk AS (
  SELECT 0::BIGINT AS n, []::BIGINT[] AS seeds, NULL::BIGINT AS item_id, NULL::BIGINT AS seed
  UNION ALL
  SELECT i.n, CASE WHEN hit IS NULL THEN list_append(seeds, i.item_id) ELSE seeds END, i.item_id, coalesce(hit, i.item_id)
  FROM (SELECT w.n, w.seeds, ids.item_id, (SELECT min(near.a) FROM near WHERE near.b = ids.item_id AND list_contains(w.seeds, near.a)) AS hit FROM walk w JOIN ids ON ids.n = w.n + 1) x JOIN ids i ON i.item_id = x.item_id)
SELECT item_id, seed FROM walk WHERE n > 0"""
)
def intent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "benchmark")
    vectors, _ = _vectors(items, "item_id")
    return sim.intent_groups(items.select("item_id"), sim.similar_pairs(vectors, "item_id", 0.8), "item_id")


@family.query(
    "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0),"
    " c AS (SELECT q.vec_id AS query, v.vec_id, round(greatest(0, least(1, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))))), 5) AS cosine FROM q, v WHERE q.vec_id <> v.vec_id)"
    " SELECT query, vec_id, cosine, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS place FROM c) WHERE place <= 10"
)
def vector_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten of each query vector; every hundredth vector is a query, against all."""
    all_vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_vectors(all_vectors.where("vec_id % 100 = 0"), all_vectors, 10)



@family.query(
    "WITH h AS (SELECT vec_id, label, list_transform(list_filter(range(0, 63), lambda i: i % 8 <> 7), lambda i: embedding[i + 2] > embedding[i + 1]) AS bits FROM embeddings)"
    " SELECT label, count(*) AS vectors, count(DISTINCT bits) AS hashes, CAST(sum(len(list_filter(bits, lambda x: x))) AS BIGINT) AS ones FROM h GROUP BY label"
)
def dhash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = numeric.difference_bits(F.col("embedding"), 8)
    hashed = load(spark, sf_dir, "embeddings").select("label", bits.alias("bits"))
    ones = F.size(F.filter("bits", lambda b: b))
    return hashed.groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct("bits").alias("hashes"), F.sum(ones).alias("ones"))


@family.query(
    "WITH h AS (SELECT vec_id, label, list_transform(list_filter(range(0, 63), lambda i: i % 8 <> 7), lambda i: embedding[i + 2] > embedding[i + 1]) AS bits FROM embeddings)"
    " SELECT a.vec_id AS a, b.vec_id AS b, len(list_filter(list_zip(a.bits, b.bits), lambda p: p[1] <> p[2])) AS distance FROM h a JOIN h b ON a.label = b.label AND a.vec_id < b.vec_id WHERE len(list_filter(list_zip(a.bits, b.bits), lambda p: p[1] <> p[2])) <= 16"
)
def dhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = load(spark, sf_dir, "embeddings").select("vec_id", "label", numeric.difference_bits(F.col("embedding"), 8).alias("bits"))
    return similar_hashes(h, 16)



@family.query(
    r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '\s+id\s*=\s*("[^"]*"|''[^'']*'')', '', 'g'), '\s+', ' ', 'g'), '> <', '><', 'g'))) AS sha FROM pages"""
)
def markup_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", text.digest(text.markup_normal(F.col("html"))).alias("sha"))


@family.query(
    r"WITH t AS (SELECT unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM pages) SELECT lower(tag) AS tag, count(*) AS n FROM t GROUP BY 1"
)
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = load(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy(F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@family.query(
    "SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'artwork') AS slug, round_even(p_retailprice, 0) AS rounded FROM part"
)
def slugs_and_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"), F.bround("p_retailprice", 0).alias("rounded"))
