"""Gate, buckets, verdicts and orders over documents with their labels as candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.operators import relations as rel
from quarrymill.operators import rules
from quarrymill.plans.registry import Family
from quarrymill.tables import load

family = Family()


def candidate_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings derived from a document's numbers; those of unlabelled ones are missing."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    marks = load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    d, n = F.col("doc_id"), F.col("n_chars")
    return docs.join(marks, "doc_id", "left").select(
        "doc_id", F.col("source").alias("preset"), F.col("lang").alias("prompt_family"), "quality", "toxic", "n_chars",
        (n % 61).cast("int").alias("speckle_count"), (n % 61).cast("int").alias("filter_speckle"),
        F.when(d % 5 != 0, (d % 11).cast("int")).alias("declared_colors"), (d % 9).cast("int").alias("rendered_colors"),
        F.when(F.col("quality").isNotNull(), (n % 1000) / 100.0).alias("mae_art"), F.when(d % 7 != 0, (d % 37).cast("double")).alias("luma_delta"),
        (n % 700).cast("int").alias("node_count_max"), (1 - (d % 23) / 100.0).alias("silhouette_iou"), ((d % 101) / 10.0).alias("glow_area_pct"),
        F.col("toxic").alias("hard"), F.lit(None).cast("int").alias("layer_a_hard"), F.lit(None).cast("int").alias("layer_b_hard"),
        (1 - F.col("quality")).alias("advisory"), F.when(d % 97 == 0, "artwork_lost").alias("fidelity_verdict"),
    )


_VIEW = """
cand AS (
  SELECT d.doc_id, source AS preset, lang AS prompt_family, quality, toxic, n_chars, n_chars % 61 AS speckles,
    coalesce(CASE WHEN doc_id % 5 <> 0 THEN doc_id % 11 END, doc_id % 9) AS colours,
    CASE WHEN quality IS NOT NULL THEN (n_chars % 1000) / 100.0::DOUBLE END AS mae,
    CASE WHEN doc_id % 7 <> 0 THEN doc_id % 37 END AS luma, n_chars % 700 AS nodes, 1 - (doc_id % 23) / 100.0::DOUBLE AS iou,
    (doc_id % 101) / 10.0::DOUBLE AS glow, toxic AS hard, 1 - quality AS advisory, doc_id % 97 = 0 AS lost,
    CASE WHEN doc_id % 5 <> 0 THEN doc_id % 11 END AS declared, doc_id % 9 AS rendered
  FROM documents d LEFT JOIN labels l USING (doc_id)
), ruled AS (
  SELECT *,
    list_filter([CASE WHEN lost OR coalesce(mae > 8, false) THEN 'ARTWORK_LOST' END, CASE WHEN iou < 0.85 THEN 'SILHOUETTE_LOST' END,
      CASE WHEN glow > 8 THEN 'GLOW_AREA_HIGH' END, CASE WHEN colours > 8 THEN 'COLOR_CAP_EXCEEDED' END,
      CASE WHEN coalesce(hard, 0) > 0 THEN 'GEOMETRY_HARD_FAIL' END], lambda x: x IS NOT NULL) AS h,
    list_filter([CASE WHEN speckles > 40 THEN 'SPECKLE_HEAVY' END, CASE WHEN colours BETWEEN 7 AND 8 THEN 'COLORS_NEAR_CAP' END,
      CASE WHEN luma < 12 THEN 'LOW_LUMA_CONTRAST' END, CASE WHEN nodes > 500 THEN 'NODE_OVERLOAD' END,
      CASE WHEN mae > 1 AND mae <= 8 THEN 'BORDERLINE_FIDELITY' END], lambda x: x IS NOT NULL) AS w,
    concat(coalesce(preset, ''), '|s', (speckles > 0)::INT + (speckles > 5)::INT + (speckles > 20)::INT + (speckles > 40)::INT,
      '|c', (colours > 1)::INT + (colours > 3)::INT + (colours > 5)::INT + (colours > 8)::INT, '|', coalesce(prompt_family, '')) AS bucket
  FROM cand
), gated AS (
  SELECT *, CASE WHEN len(h) > 0 THEN 'drop' WHEN len(w) >= 3 THEN 'demote' ELSE 'ok' END AS disposition,
    CASE WHEN len(h) > 0 THEN h ELSE w END AS reasons FROM ruled
)
"""


@family.query(f"WITH {_VIEW} SELECT doc_id, disposition, array_to_string(reasons, ',') AS reasons, bucket FROM gated")
def gate_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = rules.gate(candidate_view(spark, sf_dir))
    return gated.select("doc_id", "disposition", F.array_join("reasons", ",").alias("reasons"), "bucket")


@family.query(f"WITH {_VIEW} SELECT disposition, reason, count(*) AS n FROM (SELECT disposition, unnest(reasons) AS reason FROM gated) GROUP BY ALL")
def gate_reasons_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = rules.gate(candidate_view(spark, sf_dir))
    return gated.select("disposition", F.explode("reasons").alias("reason")).groupBy("disposition", "reason").agg(F.count(F.lit(1)).alias("n"))


@family.query(
    f"WITH {_VIEW} SELECT bucket, count(*) AS attempts, count(*) FILTER (quality = 1) AS successes, max(doc_id) AS last_id,"
    " round((1 + count(*) FILTER (quality = 1)) / (2.0::DOUBLE + count(*)), 6) AS posterior_mean FROM gated GROUP BY bucket"
)
def bucket_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = rules.gate(candidate_view(spark, sf_dir))
    n, good = F.count(F.lit(1)), F.count_if(F.col("quality") == 1)
    return gated.groupBy("bucket").agg(n.alias("attempts"), good.alias("successes"), F.max("doc_id").alias("last_id"), F.round((1 + good) / (2.0 + n), 6).alias("posterior_mean"))


@family.query(
    f"WITH {_VIEW} SELECT doc_id, regexp_extract(bucket, '^(.*)\\|s([0-9]+)\\|c([0-9]+)\\|(.*)$', 1) AS preset,"
    " CAST(regexp_extract(bucket, '^(.*)\\|s([0-9]+)\\|c([0-9]+)\\|(.*)$', 2) AS BIGINT) AS speckle_bin,"
    " CAST(regexp_extract(bucket, '^(.*)\\|s([0-9]+)\\|c([0-9]+)\\|(.*)$', 3) AS BIGINT) AS colour_bin,"
    " regexp_extract(bucket, '^(.*)\\|s([0-9]+)\\|c([0-9]+)\\|(.*)$', 4) AS family FROM gated"
)
def bucket_key_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = rules.gate(candidate_view(spark, sf_dir)).select("doc_id", *rules.bucket_parts(F.col("bucket")))
    return gated.withColumns({c: F.col(c).cast("long") for c in ("speckle_bin", "colour_bin")})


@family.query(
    """
SELECT layer, CAST(count(*) FILTER (severity = 'hard') AS BIGINT) AS hard, CAST(count(*) FILTER (severity = 'advisory') AS BIGINT) AS advisory
FROM (SELECT l_linestatus AS layer, CASE WHEN l_returnflag = 'N' THEN 'advisory' WHEN l_returnflag = 'A' AND l_discount < 0.05 THEN 'advisory' ELSE 'hard' END AS severity FROM lineitem)
GROUP BY layer"""
)
def severity_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem")
    rule = F.when((F.col("l_returnflag") == "A") & (F.col("l_discount") < 0.05), "N").otherwise(F.col("l_returnflag"))
    found = items.select(F.col("l_linestatus").alias("layer"), rules.severity(rule, ["N"]).alias("severity"))
    return found.groupBy("layer").pivot("severity", ["hard", "advisory"]).count().na.fill(0)


_VERDICT = """
comp AS (
  SELECT o_orderkey AS file, max(o_totalprice) AS total, coalesce(max(l_discount) * 100, NULL) AS mae, count(l_linenumber) AS declared,
    count(*) FILTER (l_returnflag = 'R') AS rendered, count(*) FILTER (l_tax > 0.07) AS advisory, count(*) FILTER (l_quantity > 49) AS hard
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
), judged AS (
  SELECT *, CASE WHEN mae > 8 THEN 'artwork_lost' WHEN declared <> 0 AND rendered < 0.5 * declared THEN 'colour_dropped' WHEN mae > 1 THEN 'drift' ELSE 'faithful' END AS verdict FROM comp
), placed AS (
  SELECT *, CASE verdict WHEN 'faithful' THEN 0 WHEN 'drift' THEN 1 WHEN 'artwork_lost' THEN 3 ELSE 2 END AS vr FROM judged
)"""


def comparison_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey")
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", "l_linenumber", "l_returnflag", "l_tax", "l_quantity")
    readings = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        (F.max("l_discount") * 100).alias("mae_art"), F.count("l_linenumber").alias("declared"), F.count_if(F.col("l_returnflag") == "R").alias("rendered"),
        F.count_if(F.col("l_tax") > 0.07).alias("advisory"), F.count_if(F.col("l_quantity") > 49).alias("hard"),
    )
    full = orders.join(readings, "o_orderkey", "left").na.fill(0, ["declared", "rendered", "advisory", "hard"]).withColumnRenamed("o_orderkey", "file")
    judged = full.withColumn("verdict", rules.fidelity_verdict(F.col("mae_art"), F.col("declared"), F.col("rendered")))
    return judged.withColumn("verdict_rank", rules.verdict_rank(F.col("verdict")))


@family.query(
    f"WITH {_VERDICT} SELECT file, verdict, hard, advisory, row_number() OVER (PARTITION BY file // 100 ORDER BY hard, vr, advisory, coalesce(mae, 0), file) AS position FROM placed"
)
def fidelity_verdict_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position within each run of candidates (a run: a hundred order keys in sequence)."""
    view = comparison_view(spark, sf_dir)
    w = Window.partitionBy(F.floor(F.col("file") / 100)).orderBy(*rel.comparison_order())
    return view.select("file", "verdict", "hard", "advisory", F.row_number().over(w).cast("long").alias("position"))


@family.query(f"WITH {_VERDICT} SELECT file, advisory + (verdict = 'artwork_lost')::INT AS advisory, CASE WHEN verdict = 'artwork_lost' THEN 'ARTWORK_LOST' ELSE '' END AS added FROM placed")
def advisory_augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    view, lost = comparison_view(spark, sf_dir), F.col("verdict") == "artwork_lost"
    return view.select("file", (F.col("advisory") + lost.cast("int")).cast("long").alias("advisory"), F.when(lost, "ARTWORK_LOST").otherwise("").alias("added"))


@family.query(
    f"WITH {_VIEW} SELECT doc_id, position FROM (SELECT doc_id, row_number() OVER (ORDER BY hard NULLS LAST, advisory NULLS LAST,"
    " CASE WHEN mae IS NOT NULL THEN least(greatest(mae, 0), 999.999) END NULLS LAST, doc_id) AS position FROM cand) WHERE position <= 50"
)
def hand_order_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty only (that is the feature): ordered partially before the window."""
    order = rel.hand_order("doc_id")
    top = candidate_view(spark, sf_dir).select("doc_id", "hard", "advisory", "mae_art").orderBy(*order).limit(50)
    return top.select("doc_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("position"))


@family.query(
    f"WITH {_VIEW} SELECT doc_id, round(score, 6) AS score, position FROM (SELECT *, row_number() OVER (PARTITION BY doc_id // 64 ORDER BY round(score, 9) DESC, hard IS NULL, hard, advisory IS NULL, advisory, mae IS NULL, least(greatest(mae, 0), 999.999), doc_id) AS position FROM (SELECT *,"
    " 0.5::DOUBLE * (colours - 4) / 2 - 0.25::DOUBLE * (coalesce(mae, 5.0) - 5) / 3 + 0.1::DOUBLE * (nodes - 350) / 200 AS score FROM cand))"
)
def ranker_score_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.operators.learning import hand_key, score

    model = {
        "kind": "pairwise", "features": ["colours", "mae_art", "node_count_max"], "weights": {"colours": 0.5, "mae_art": -0.25, "node_count_max": 0.1},
        "means": {"colours": 4.0, "mae_art": 5.0, "node_count_max": 350.0}, "scales": {"colours": 2.0, "mae_art": 3.0, "node_count_max": 200.0},
    }
    view = candidate_view(spark, sf_dir).withColumn("colours", rules.colours())
    scored = view.select("doc_id", "hard", "advisory", "mae_art", score(model).alias("raw"))
    # a job is a run of 64 documents; scores are rounded so that both engines see the same ties
    w = Window.partitionBy(F.floor(F.col("doc_id") / 64)).orderBy(F.round("raw", 9).desc(), *hand_key(), "doc_id")
    return scored.select("doc_id", F.round("raw", 6).alias("score"), F.row_number().over(w).cast("long").alias("position"))


@family.query(
    f"WITH {_VIEW} SELECT doc_id, CASE WHEN len(m) = 0 THEN 'complete' WHEN list_contains(m, 'quality') THEN 'blocked' ELSE 'open' END AS state, array_to_string(m, ',') AS missing"
    " FROM (SELECT doc_id, list_filter([CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN luma IS NULL THEN 'luma' END, CASE WHEN declared IS NULL THEN 'declared' END], lambda x: x IS NOT NULL) AS m FROM cand)"
)
def link_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(n)) for c, n in (("quality", "quality"), ("luma_delta", "luma"), ("declared_colors", "declared")))))
    state = F.when(F.size("m") == 0, "complete").when(F.array_contains("m", "quality"), "blocked").otherwise("open")
    return candidate_view(spark, sf_dir).select("doc_id", missing.alias("m")).select("doc_id", state.alias("state"), F.array_join("m", ",").alias("missing"))


@family.query(
    f"WITH {_VIEW} SELECT prompt_family AS run, CASE WHEN count(*) = 0 THEN 'EMPTY' WHEN count(*) FILTER (disposition = 'ok') > 0 THEN 'PASS' ELSE 'NOPASS' END AS verdict,"
    " count(*) AS candidates, count(*) FILTER (disposition = 'ok') AS passed FROM gated GROUP BY prompt_family"
)
def run_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = rules.gate(candidate_view(spark, sf_dir))
    ok = F.count_if(F.col("disposition") == "ok")
    return gated.groupBy(F.col("prompt_family").alias("run")).agg(F.when(ok > 0, "PASS").otherwise("NOPASS").alias("verdict"), F.count(F.lit(1)).alias("candidates"), ok.alias("passed"))
