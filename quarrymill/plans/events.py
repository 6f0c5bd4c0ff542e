"""The event log: folds, pairs, features, buckets, windows and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.operators import learning as lrn
from quarrymill.operators import relations as rel
from quarrymill.plans.registry import Family
from quarrymill.tables import load

family = Family()

_LOG = "log AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t, CAST(user_id AS VARCHAR) AS job, CAST(event_id % 50 AS VARCHAR) AS sha, CASE event_type WHEN 'view' THEN 'shown' WHEN 'purchase' THEN ' Pick' WHEN 'error' THEN 'reject' ELSE event_type END AS event, event_id % 13 AS pos, value FROM events)"
_FOLD = f"""{_LOG}, signed AS (SELECT *, CASE WHEN lower(trim(event)) IN ('star','pick','proof','chosen','selected') THEN 1 WHEN lower(trim(event)) IN ('unstar','discard','delete','reject','rejected') THEN -1 ELSE 0 END AS sgn, event = 'shown' AS s FROM log),
fold AS (SELECT job, sha, bool_or(s) AS shown, coalesce(arg_max(pos, (t, job, sha, event, pos)) FILTER (s), arg_min(pos, (t, job, sha, event, pos)) FILTER (NOT s)) AS pos,
  CASE WHEN max(sgn) > 0 THEN 1 WHEN min(sgn) < 0 THEN -1 ELSE 0 END AS action, max(t) AS last_t FROM signed GROUP BY job, sha)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return events.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"), F.col("user_id").cast("string").alias("job"), (F.col("event_id") % 50).cast("string").alias("svg_sha"),
        F.when(F.col("event_type") == "view", "shown").when(F.col("event_type") == "purchase", " Pick").when(F.col("event_type") == "error", "reject").otherwise(F.col("event_type")).alias("event"), (F.col("event_id") % 13).cast("int").alias("pos"), "value",
    )


@family.query(f"WITH {_FOLD} SELECT job, sha, shown, pos, action, last_t FROM fold")
def event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = lrn.fold_events(event_log(spark, sf_dir)).withColumnRenamed("svg_sha", "sha")
    return folded.withColumns({"pos": F.col("pos").cast("long"), "action": F.col("action").cast("long")})


@family.query(f"WITH {_FOLD} SELECT a.job, count(*) AS pairs FROM fold a JOIN fold b ON a.job = b.job AND a.action > 0 AND (b.action < 0 OR (b.action = 0 AND b.shown)) GROUP BY a.job")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lrn.preference_pairs(lrn.fold_events(event_log(spark, sf_dir)))
    return pairs.groupBy("job").agg(F.count(F.lit(1)).alias("pairs"))


@family.query(f"WITH {_FOLD}, j AS (SELECT DISTINCT job FROM fold), n AS (SELECT count(*) AS n FROM j) SELECT job, row_number() OVER (ORDER BY job) > n - least(ceil(n * 0.2), n - 1) AS held_out FROM j, n")
def job_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lrn.held_out_jobs(lrn.fold_events(event_log(spark, sf_dir)))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return log.groupBy("job", "svg_sha").agg(F.avg("value").alias("level"), F.count(F.lit(1)).cast("double").alias("lines"), F.max("pos").cast("double").alias("place")).withColumn("key", F.concat("job", F.lit("/"), "svg_sha"))


@family.query(
    f"WITH {_LOG}, f AS (SELECT job, sha, avg(value) AS level, count(*)::DOUBLE AS lines, max(pos)::DOUBLE AS place FROM log GROUP BY ALL)"
    " SELECT 'level' AS feature, round(avg(level), 6) AS mean, round(stddev_pop(level), 6) AS scale FROM f UNION ALL SELECT 'lines', round(avg(lines), 6), round(stddev_pop(lines), 6) FROM f UNION ALL SELECT 'place', round(avg(place), 6), round(stddev_pop(place), 6) FROM f"
)
def feature_matrix_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lrn.feature_scales(_features(spark, sf_dir), ["level", "lines", "place"]).select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@family.query()
def pairwise_ranker_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed-step fit with the settings of ``config.FIT``: three hundred full-batch steps."""
    features = _features(spark, sf_dir)
    pairs = lrn.preference_pairs(lrn.fold_events(event_log(spark, sf_dir)))
    keyed = pairs.select("job", F.concat("job", F.lit("/"), "winner").alias("winner"), F.concat("job", F.lit("/"), "loser").alias("loser"))
    model = lrn.fit_ranker(features, keyed, "key", ["level", "lines", "place"])
    return spark.createDataFrame([(f, float(w)) for f, w in model["weights"].items()], "feature string, weight double")


_BUCKETS = "b AS (SELECT event_type || '|' || CAST(user_id % 7 AS VARCHAR) AS bucket, value > 50 AS good, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t FROM events)"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.concat("event_type", F.lit("|"), (F.col("user_id") % 7).cast("string"))
    return load(spark, sf_dir, "events").select(bucket.alias("bucket"), (F.col("value") > 50).alias("success"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))


@family.query(
    f"WITH {_BUCKETS}, s AS (SELECT bucket, count(*) AS n, count(*) FILTER (good) AS k, max(t) AS last_t FROM b GROUP BY 1), e AS (SELECT *, last_t < '2024-01-30T12:00:00' AS gone FROM s)"
    " SELECT bucket, n AS attempts, k AS successes, gone AS expired, round(CASE WHEN gone THEN 0.5 ELSE (1 + k) / (2.0::DOUBLE + n) END, 6) AS posterior_mean FROM e"
)
def bandit_posterior_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-02-29 12:00:00").cast("timestamp")
    live = lrn.live_posterior(lrn.bucket_stats(_outcomes(spark, sf_dir)), now)
    return live.select("bucket", "attempts", "successes", "expired", F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")), 6).alias("posterior_mean"))


@family.query()
def bandit_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lrn.choose_bucket(lrn.bucket_stats(_outcomes(spark, sf_dir)), F.lit("2024-02-01 00:00:00").cast("timestamp"), seed=11)


@family.query("SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def daily_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return events.select(F.to_date("window.start").alias("day"), "event_type", "n", "total")


@family.query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),"
    " s AS (SELECT user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, sid AS session, count(*) AS n FROM s GROUP BY ALL"
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.gap_sessions(load(spark, sf_dir, "events"), "user_id", "ts", 1800).withColumn("session", F.col("session").cast("long"))


@family.query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("user_id", F.from_json("props", "k long").alias("p"))
    return events.groupBy((F.col("p.k") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
