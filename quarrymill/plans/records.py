"""Provenance stitching, fallbacks, duplicates, boards, samples and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import text
from quarrymill.operators import relations as rel
from quarrymill.operators import rules
from quarrymill.plans.registry import Family
from quarrymill.tables import load

family = Family()

_SWEEP = """
sweep AS (SELECT o_orderkey AS file, o_orderpriority AS preset, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0),
comp AS (SELECT l_orderkey AS file, count(*) AS nodes, CASE WHEN min(l_linestatus) = 'O' THEN 'O' END AS status FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY l_orderkey)
"""


def _sweep(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sweep = load(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("preset"), F.col("o_orderstatus").alias("status"))
    comp = load(spark, sf_dir, "lineitem").where("l_orderkey % 5 <> 0").groupBy(F.col("l_orderkey").alias("file"))
    return sweep, comp.agg(F.count(F.lit(1)).alias("nodes"), F.when(F.min("l_linestatus") == "O", "O").alias("status"))


@family.query(
    f"WITH {_SWEEP} SELECT coalesce(s.file, c.file) AS file, preset, nodes, coalesce(c.status, s.status) AS status,"
    " CASE WHEN s.file IS NULL THEN 'right' WHEN c.file IS NULL THEN 'left' ELSE 'both' END AS origin FROM sweep s FULL JOIN comp c ON s.file = c.file"
)
def record_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.stitch(*_sweep(spark, sf_dir), "file")


@family.query(f"WITH {_SWEEP} SELECT c.file, nodes FROM comp c ANTI JOIN sweep s ON s.file = c.file")
def stale_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep, comp = _sweep(spark, sf_dir)
    return rel.graded_and_stale(sweep, comp, "file")[1].select("file", "nodes")


@family.query(f"WITH {_SWEEP} SELECT s.file, preset, c.file IS NOT NULL AS on_disk FROM sweep s LEFT JOIN comp c ON s.file = c.file")
def graded_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep, comp = _sweep(spark, sf_dir)
    return rel.graded_and_stale(sweep, comp, "file")[0].select("file", "preset", "on_disk")


@family.query(
    """
WITH scoped AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
flat AS (SELECT s_nationkey AS n, max(s_acctbal) AS v FROM supplier WHERE s_acctbal > 0 GROUP BY 1)
SELECT c_custkey, round(coalesce(scoped.v, flat.v), 2) AS value, CASE WHEN scoped.v IS NOT NULL THEN 'scoped' WHEN flat.v IS NOT NULL THEN 'flat' ELSE 'absent' END AS scope
FROM customer LEFT JOIN scoped ON c_custkey = k LEFT JOIN flat ON c_nationkey = n"""
)
def fallback_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("scoped"))
    flat = load(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("flat"))
    joined = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(scoped, "c_custkey", "left").join(flat, "c_nationkey", "left")
    value, scope = rel.first_of(("scoped", F.col("scoped")), ("flat", F.col("flat")))
    return joined.select("c_custkey", F.round(value, 2).alias("value"), scope.alias("scope"))


@family.query(
    """
WITH places AS (
  SELECT p_partkey AS k, 1 AS pri, 'catalogue' AS place FROM part WHERE p_size > 25
  UNION ALL SELECT l_partkey, 2, 'shipped' FROM lineitem WHERE l_quantity > 45
  UNION ALL SELECT s_suppkey, 3, 'supplier' FROM supplier)
SELECT k AS key, arg_min(place, pri) AS place, count(DISTINCT pri) AS places FROM places GROUP BY k"""
)
def priority_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("key"), F.lit(1).alias("pri"), F.lit("catalogue").alias("place"))
    b = load(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey", F.lit(2), F.lit("shipped"))
    c = load(spark, sf_dir, "supplier").select("s_suppkey", F.lit(3), F.lit("supplier"))
    return a.union(b).union(c).groupBy("key").agg(F.min_by("place", "pri").alias("place"), F.count_distinct("pri").alias("places"))


@family.query(
    """
WITH h AS (SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS sha FROM documents)
SELECT doc_id, sha, first_id, n FROM (SELECT doc_id, sha, min(doc_id) OVER (PARTITION BY sha) AS first_id, count(*) OVER (PARTITION BY sha) AS n FROM h) WHERE n > 1"""
)
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", text.digest(text.normal(F.col("text"))).alias("sha"))
    return rel.duplicate_groups(docs, "sha", "doc_id").select("doc_id", "sha", F.col("first").alias("first_id"), "n")



@family.query(
    "SELECT doc_id, CASE WHEN doc_id <> f THEN f END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS f FROM documents)"
)
def duplicate_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", text.digest(F.col("text")).alias("sha"))
    return rel.mark_duplicates(docs, "sha", "doc_id").select("doc_id", "duplicate_of")


@family.query(
    "SELECT rule, owners FROM (SELECT l_linenumber AS rule, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY 1) WHERE owners = (SELECT count(DISTINCT l_suppkey) FROM lineitem)"
)
def common_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("rule"), "l_suppkey")
    return rel.common_to_all(items, "rule", "l_suppkey")


_KINDS = ["layer_a_passed", "layer_b_passed", "back_half_passed", "tac_exact", "no_continuous_tone", "rendered_colors_le", "node_max_le", "vtracer_only", "unique", "visual_review_present", "human_decision_present", "unheard_of"]
_VALUES = {"rendered_colors_le": "20", "node_max_le": "300"}
_RECORD = """
c AS (SELECT o_custkey % 10 AS run, o_orderkey AS id, o_orderkey % 3 <> 0 AS comp, CASE o_orderkey % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN '' WHEN 3 THEN 'pass' END AS la,
  CASE o_custkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'skipped' END AS lb, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS back, o_orderkey % 2 = 0 AS passed,
  CASE o_orderkey % 7 WHEN 0 THEN true WHEN 1 THEN false END AS tac, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN false END AS tone,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 31 END AS inks, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 701 END AS nodes,
  CASE o_orderkey % 4 WHEN 0 THEN 'vtracer_api' WHEN 1 THEN 'vtracer_cli' WHEN 2 THEN 'other' END AS backend, CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey - 1 END AS dup,
  o_orderkey % 4 = 1 AS seen, o_orderkey % 8 = 1 AS decided, CASE WHEN o_orderkey % 16 = 1 THEN 'production' ELSE 'reject' END AS label, o_orderkey % 3 AS missing, o_orderkey % 4 AS open FROM orders)"""


def record_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda x, **at: F.coalesce(*(F.when(x == int(i[1:]), F.lit(v)) for i, v in at.items()))
    return load(spark, sf_dir, "orders").select(
        (c % 10).alias("run"), k.alias("id"), (k % 3 != 0).alias("has_comparison"), pick(k % 5, _0="pass", _1="fail", _2="", _3="pass").alias("layer_a_status"),
        pick(c % 4, _0="pass", _1="skipped").alias("layer_b_status"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("back_run"),
        (k % 2 == 0).alias("manifest_passed"), pick(k % 7, _0=True, _1=False).alias("tac_exact"), pick(k % 6, _0=True, _1=False).alias("rendered_continuous_tone"),
        F.when(k % 3 != 0, k % 31).alias("rendered_ink_colors"), F.when(k % 3 == 1, k % 701).alias("node_count_max"), pick(k % 4, _0="vtracer_api", _1="vtracer_cli", _2="other").alias("backend_kind"),
        F.when(k % 9 == 0, k - 1).alias("duplicate_of"), (k % 4 == 1).alias("visual_found"), (k % 8 == 1).alias("decision_found"),
        F.when(k % 16 == 1, "production").otherwise("reject").alias("decision_label"), (k % 3 != 0).alias("comparison_passed"),
        F.array_repeat(F.lit("link"), (k % 3).cast("int")).alias("missing_links"), F.array_repeat(F.lit("item"), (k % 4).cast("int")).alias("open_items"),
    )


@family.query(
    f"""
WITH {_RECORD}, req(kind) AS (VALUES {", ".join(f"('{k}')" for k in _KINDS)}),
b AS (SELECT kind AS check_type, CASE
  WHEN kind = 'layer_a_passed' THEN CASE WHEN NOT comp OR la IS NULL OR la = '' THEN 'N/A' WHEN la = 'pass' THEN 'PASS' ELSE 'FAIL' END
  WHEN kind = 'layer_b_passed' THEN CASE WHEN NOT comp OR lb IS NULL OR lb = '' THEN 'N/A' WHEN lb = 'pass' THEN 'PASS' ELSE 'FAIL' END
  WHEN kind IN ('back_half_passed', 'tac_exact', 'no_continuous_tone') AND back IS NOT TRUE THEN 'N/A'
  WHEN kind = 'back_half_passed' THEN CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END
  WHEN kind = 'tac_exact' THEN CASE WHEN tac IS TRUE THEN 'PASS' ELSE 'FAIL' END
  WHEN kind = 'no_continuous_tone' THEN CASE WHEN tone IS FALSE THEN 'PASS' ELSE 'FAIL' END
  WHEN kind = 'rendered_colors_le' THEN CASE WHEN inks IS NULL THEN 'N/A' WHEN inks <= 20 THEN 'PASS' ELSE 'FAIL' END
  WHEN kind = 'node_max_le' THEN CASE WHEN nodes IS NULL THEN 'N/A' WHEN nodes <= 300 THEN 'PASS' ELSE 'FAIL' END
  WHEN kind = 'vtracer_only' THEN CASE WHEN backend IN ('vtracer_api', 'vtracer_cli') THEN 'PASS' ELSE 'FAIL' END
  WHEN kind = 'unique' THEN CASE WHEN dup IS NULL THEN 'PASS' ELSE 'FAIL' END
  WHEN kind = 'visual_review_present' THEN CASE WHEN seen THEN 'PASS' ELSE 'PENDING' END
  WHEN kind = 'human_decision_present' THEN CASE WHEN decided THEN 'PASS' ELSE 'PENDING' END ELSE 'N/A' END AS status FROM c, req)
SELECT check_type, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'PENDING') AS n_pending, count(*) FILTER (status = 'N/A') AS n_na FROM b GROUP BY 1"""
)
def closeout_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    requirements = spark.createDataFrame([(k, _VALUES.get(k)) for k in _KINDS], "check_type string, check_value string")
    full = rules.board(record_view(spark, sf_dir), requirements)
    count = lambda s: F.count_if(F.col("status") == s)
    return full.groupBy("check_type").agg(count("PASS").alias("n_pass"), count("FAIL").alias("n_fail"), count("PENDING").alias("n_pending"), count("N/A").alias("n_na"))


@family.query(
    f"WITH {_RECORD} SELECT run, count(*) AS candidates, count(*) FILTER (back) AS back_half, count(*) FILTER (seen) AS reviews, count(*) FILTER (decided) AS decisions,"
    " CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(open) AS BIGINT) AS open, count(*) FILTER (comp AND label = 'production') AS production_ready FROM c GROUP BY run"
)
def closeout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.closeout_counts(record_view(spark, sf_dir), "run")


@family.query(
    """
SELECT p_partkey, p_brand, turn FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS turn FROM part)
ORDER BY turn, p_brand LIMIT 60"""
)
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    taken = rel.round_robin(parts, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 60)
    return taken.select("p_partkey", "p_brand", F.col("turn").cast("long").alias("turn"))


@family.query(
    """
WITH r AS (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem)
SELECT l_suppkey, place, l_extendedprice, 1 AS rows FROM r WHERE place <= 5
UNION ALL SELECT l_suppkey, 6, round(sum(l_extendedprice), 2), count(*) FROM r WHERE place > 5 GROUP BY 1"""
)
def topk_with_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return rel.top_with_rest(items, "l_suppkey", [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 5, "l_extendedprice")


@family.query(
    "SELECT a.v AS preset, b.v AS speckle, c.v AS palette, row_number() OVER (ORDER BY a.v, b.v, c.v) AS grid FROM (VALUES ('bw'),('poster'),('photo')) a(v), (VALUES (2),(8),(16)) b(v), (VALUES (false),(true)) c(v)"
)
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    grid = rel.parameter_grid(spark.range(1), preset=["bw", "poster", "photo"], speckle=[2, 8, 16], palette=[False, True]).drop("id")
    return grid.withColumn("grid", F.row_number().over(Window.orderBy("preset", "speckle", "palette")).cast("long"))


@family.query(
    """
WITH e AS (SELECT event_id, user_id, ts, props, CASE WHEN event_id % 50 = 0 THEN true ELSE false END AS link, date_diff('hour', ts, TIMESTAMP '2024-02-01') AS age FROM events),
live AS (SELECT DISTINCT CAST(regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS stem FROM pages WHERE regexp_extract(url, '([0-9]+)[^0-9]*$', 1) <> '')
SELECT CASE WHEN link THEN 'skip_symlink' WHEN stem IS NOT NULL THEN 'keep_live' WHEN age < 240 THEN 'keep_grace' ELSE 'target' END AS disposition,
  count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS bytes, max(event_id) AS newest FROM e LEFT JOIN live ON stem = user_id GROUP BY 1"""
)
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.nullif(F.regexp_extract("url", r"([0-9]+)[^0-9]*$", 1), F.lit("")).cast("long")
    live = load(spark, sf_dir, "pages").select(stem.alias("stem")).where("stem IS NOT NULL").distinct()
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", "props", (F.date_diff(F.lit("2024-02-01").cast("date"), F.to_date("ts")) * 24 - F.hour("ts")).alias("age"))
    joined = rows.join(live, rows["user_id"] == live["stem"], "left")
    what = rules.retention(F.col("event_id") % 50 == 0, F.col("age"), F.col("stem").isNotNull(), 240)
    return joined.groupBy(what.alias("disposition")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("props")).alias("bytes"), F.max("event_id").alias("newest"))


@family.query(
    "SELECT s_suppkey, s_acctbal, CASE WHEN s_acctbal * 500000 < 1073741824 THEN 'refuse' WHEN s_acctbal * 500000 < 2147483648 THEN 'warn' ELSE 'ok' END AS gate FROM supplier"
)
def disk_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", rules.disk_gate(F.col("s_acctbal") * 500000).alias("gate"))


@family.query(
    "SELECT n_name, count(DISTINCT c_mktsegment) AS segments, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS names FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
)
def distinct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count_distinct("c_mktsegment").alias("segments"), F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ",").alias("names"))


@family.query(
    "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice, p_partkey) AS n FROM part) WHERE n = 1"
)
def dedupe_by_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey", "p_retailprice")
    key = F.to_json(F.struct("p_brand", "p_size"))
    return rel.distinct_by(parts, key, [F.col("p_retailprice"), F.col("p_partkey")]).select("p_brand", "p_partkey", "p_retailprice")


@family.query(
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, grouping(l_returnflag) + 2 * grouping(l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"
)
def cube_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension."""
    items = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    level = (F.grouping("l_returnflag") + 2 * F.grouping("l_linestatus")).cast("long")
    return items.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), level.alias("level"))


@family.query(
    "SELECT event_id, e.user_id, o.o_orderstatus AS decision FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate"
)
def asof_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the latest order status of the customer at the time of an event."""
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    decisions = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), "o_orderdate").agg(F.max("o_orderstatus").alias("decision"))
    return rel.as_of(events, decisions, "user_id", "ts", "o_orderdate", "decision").select("event_id", "user_id", "decision")
