"""Orders, prep checks, notes, maps and joins of the curation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.operators import learning as lrn
from quarrymill.operators import relations as rel
from quarrymill.operators import rules
from quarrymill.plans.events import _FOLD, event_log
from quarrymill.plans.records import record_view
from quarrymill.plans.registry import Family
from quarrymill.tables import load

family = Family()

_PLACED = "row_number() OVER (PARTITION BY c_nationkey ORDER BY {order}) AS position"


def _placed(df: DataFrame, order: list) -> DataFrame:
    """Place in the report of a run (here: a customer's nation in buckets of a hundred keys)."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy("run").orderBy(*order)).cast("long"))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report entries: some with an error, some unmeasured, many ties; a run holds some 24 of them."""
    c = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(
        F.floor(c / 24).alias("run"), c.alias("id"), (c % 7 == 0).alias("error"), (c % 11).alias("colours"), F.when(c % 5 != 0, (c % 3).cast("double")).alias("energy"),
        F.when(c % 4 != 0, (c % 13).cast("double")).alias("mae_art"), F.when(c % 6 != 0, c % 9).alias("nodes_max"), F.when(c % 8 != 0, c % 2 == 0).alias("passed"), (c % 3).alias("advisory"),
    )


_REPORT = """rep AS (SELECT c_custkey // 24 AS run, c_custkey AS id, c_custkey % 7 = 0 AS error, c_custkey % 11 AS colours, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 3 END AS energy,
  CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 13 END AS mae, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 9 END AS nodes, CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 2 = 0 END AS passed, c_custkey % 3 AS advisory FROM customer)"""


@family.query(f"WITH {_REPORT} SELECT id, row_number() OVER (PARTITION BY run ORDER BY mae, id) AS position FROM rep WHERE mae IS NOT NULL")
def fidelity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By artwork error, measured ones only."""
    return _placed(_report(spark, sf_dir).where("mae_art IS NOT NULL"), [F.col("mae_art"), F.col("id")]).select("id", "position")


@family.query(f"WITH {_REPORT} SELECT id, row_number() OVER (PARTITION BY run ORDER BY error, CASE WHEN error THEN 0 ELSE colours END, CASE WHEN error THEN 0 ELSE coalesce(energy, 0) END, id) AS position FROM rep")
def filter_bench_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors last; then fewest colours to 95 %, least edge energy, name."""
    return _placed(_report(spark, sf_dir), rel.bench_order("error", "colours", "energy", "id")).select("id", "position")


@family.query(f"WITH {_REPORT} SELECT id, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN passed IS NULL OR error THEN 2 WHEN passed THEN 0 ELSE 1 END, CASE WHEN passed IS NULL OR error THEN 0 ELSE advisory END, id) AS position FROM rep")
def variant_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passed first, then fewest advisories; without a usable reading last."""
    return _placed(_report(spark, sf_dir), rel.variant_order("passed", "error", "advisory", "id")).select("id", "position")


@family.query(f"WITH {_REPORT} SELECT id, row_number() OVER (PARTITION BY run ORDER BY mae NULLS LAST, nodes NULLS LAST, id) AS position FROM rep")
def tune_cell_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(_report(spark, sf_dir), rel.cell_order("mae_art", "nodes_max", "id")).select("id", "position")


@family.query(
    f"WITH {_REPORT} SELECT run, count(*) AS cells, count(*) FILTER (error) AS errored, count(*) FILTER (NOT error AND coalesce(nodes <= 4, false)) AS cleared, count(*) FILTER (NOT error AND NOT coalesce(nodes <= 4, false) AND passed) AS helped FROM rep GROUP BY run"
)
def tune_cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, faulty ones, those that clear the gate as traced, and those that do so only once reduced."""
    cleared = ~F.col("error") & F.coalesce(F.col("nodes_max") <= 4, F.lit(False))
    helped = ~F.col("error") & ~F.coalesce(F.col("nodes_max") <= 4, F.lit(False)) & F.coalesce("passed", F.lit(False))
    return _report(spark, sf_dir).groupBy("run").agg(F.count(F.lit(1)).alias("cells"), F.count_if("error").alias("errored"), F.count_if(cleared).alias("cleared"), F.count_if(helped).alias("helped"))


@family.query(
    """WITH i AS (SELECT l_suppkey AS page, l_linenumber AS x, l_quantity AS xp, l_extendedprice / 1000 AS yp, l_orderkey AS k FROM lineitem WHERE least(l_quantity, l_extendedprice / 1000) < 20)
SELECT page, count(*) AS weak, round(min(least(xp, yp)), 6) AS worst FROM i GROUP BY page"""
)
def worst_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images below the least resolution of a page, and the worst of them."""
    items = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_quantity").alias("x_ppi"), (F.col("l_extendedprice") / 1000).alias("y_ppi"))
    return rel.weak_images(items, "page", 20.0).select("page", "weak", F.round("worst", 6).alias("worst"))


@family.query(
    """WITH h AS (SELECT l_suppkey AS image, l_partkey % 64 AS rgb, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT image, rgb, n, place FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY n DESC, rgb) AS place FROM h) WHERE place <= 12"""
)
def top_inks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve heaviest inks of each image (that number is the feature), the colour breaking ties."""
    counts = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image"), (F.col("l_partkey") % 64).alias("rgb")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("image").orderBy(F.col("n").desc(), "rgb")
    return counts.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 12")


@family.query(
    """WITH p AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '.gif' ELSE '.jpg' END AS ext, CASE p_size % 4 WHEN 0 THEN 'RGBA' WHEN 1 THEN 'CMYK' WHEN 2 THEN 'P' ELSE 'RGB' END AS mode, 900 + p_partkey % 200 AS w, 500 AS h, CASE WHEN p_size % 7 <> 0 THEN p_size::DOUBLE END AS sigma FROM part)
SELECT p_partkey, concat_ws(',', 'format:' || CASE WHEN lower(ext) IN ('.png', '.jpg') THEN 'pass' ELSE 'warn' END, 'color_mode:' || CASE WHEN mode IN ('RGB', 'RGBA') THEN 'pass' ELSE 'warn' END, 'alpha:' || CASE WHEN mode = 'RGBA' THEN 'warn' ELSE 'pass' END,
  'aspect_ratio:' || CASE WHEN abs(w / h::DOUBLE - 2.0) / 2.0 > 0.02 THEN 'fail' ELSE 'pass' END, 'physical_size:' || CASE WHEN w / 300.0::DOUBLE * 25.4 < 100 * 0.9 OR h / 300.0::DOUBLE * 25.4 < 50 * 0.9 THEN 'warn' ELSE 'pass' END,
  'background:' || CASE WHEN sigma IS NULL THEN 'info' WHEN sigma < 16 THEN 'pass' ELSE 'warn' END) AS checks, NOT abs(w / h::DOUBLE - 2.0) / 2.0 > 0.02 AS acceptable FROM p"""
)
def prep_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    view = load(spark, sf_dir, "part").select(
        "p_partkey", F.when(size % 5 == 0, ".PNG").when(size % 5 == 1, ".gif").otherwise(".jpg").alias("ext"), F.when(size % 4 == 0, "RGBA").when(size % 4 == 1, "CMYK").when(size % 4 == 2, "P").otherwise("RGB").alias("mode"),
        (900 + key % 200).alias("w_px"), F.lit(500).alias("h_px"), F.when(size % 7 != 0, size.cast("double")).alias("border_sigma"),
    )
    checked = view.withColumn("checks", rules.prep_checks(100.0, 50.0, 300.0))
    return checked.select("p_partkey", F.array_join(F.transform("checks", lambda c: F.concat(c["check"], F.lit(":"), c["status"])), ",").alias("checks"), rules.acceptable(F.col("checks")).alias("acceptable"))


@family.query(
    """WITH o AS (SELECT o_orderkey, o_custkey, list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'manifest' END, CASE WHEN o_orderkey % 3 = 0 THEN 'proof' END], lambda x: x IS NOT NULL) AS l FROM orders)
SELECT o_orderkey, len(l) AS n, array_to_string(list_transform(l, lambda x: concat(x, ' read from the shared flat name ', chr(39), x, '/', o_custkey, chr(39), ' -- not attributable to this run')), ';') AS notes FROM o"""
)
def shared_name_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    entry = lambda label, m: F.struct(F.lit(label).alias("label"), F.concat(F.lit(f"{label}/"), F.col("o_custkey")).alias("path"), F.when(k % m == 0, "flat").otherwise("scoped").alias("scope"))
    found = load(spark, sf_dir, "orders").select("o_orderkey", rules.shared_name_notes(F.array(entry("manifest", 2), entry("proof", 3))).alias("notes"))
    return found.select("o_orderkey", F.size("notes").cast("long").alias("n"), F.array_join("notes", ";").alias("notes"))


@family.query(
    """SELECT p_partkey, concat_ws(',', 'corner=' || (p_size % 9), CASE WHEN p_size % 2 = 0 THEN 'speckle=' || (p_size % 5) END) AS kept, CASE WHEN p_size % 2 = 0 THEN 'mode' ELSE 'mode,speckle' END AS dropped FROM part"""
)
def backend_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    params = F.create_map(F.lit("corner"), (size % 9).cast("string"), F.lit("speckle"), (size % 5).cast("string"), F.lit("mode"), F.lit("x"))
    flags = F.when(size % 2 == 0, F.array(F.lit("corner"), F.lit("speckle"))).otherwise(F.array(F.lit("corner")))
    kept, dropped = rules.kept_parameters(params, flags)
    pairs = F.transform(F.array_sort(F.map_entries("kept")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return load(spark, sf_dir, "part").select("p_partkey", kept.alias("kept"), dropped.alias("dropped")).select("p_partkey", F.array_join(pairs, ",").alias("kept"), F.array_join("dropped", ",").alias("dropped"))


@family.query(
    "SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'recolour map is empty' WHEN s_suppkey % 6 = 1 THEN '#12345' WHEN s_suppkey % 6 = 2 THEN '#ABCDEF' ELSE '' END AS errors FROM supplier"
)
def recolour_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 6
    pairs = F.when(k == 0, F.create_map().cast("map<string,string>")).when(k == 1, F.create_map(F.lit("#12345"), F.lit("#000000"), F.lit("#ffffff"), F.lit("#000000"))).when(k == 2, F.create_map(F.lit("#ABCDEF"), F.lit("red"))).otherwise(F.create_map(F.lit(" #ABCDEF"), F.lit("#000000")))
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(rules.recolour_errors(pairs), ",").alias("errors"))


@family.query(
    """WITH h AS (SELECT l_suppkey AS image, l_partkey % 16 AS colour, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY n DESC, colour) AS place FROM h)
SELECT image, colour, place, CASE WHEN place = 1 THEN 99 WHEN place - 1 <= 3 THEN [10, 20, 30][place - 1] ELSE 10 * (1 + CASE WHEN colour <= 15 THEN 0 ELSE 1 END) END AS slot,
  CASE WHEN place = 1 THEN 'background anchor' WHEN place - 1 <= 3 THEN 'area rank ' || (place - 1) ELSE 'collapsed onto nearest' END AS why FROM r"""
)
def palette_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours by area to palette slots; the heaviest is the background, those beyond the slots take the nearest."""
    counts = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image"), (F.col("l_partkey") % 16).alias("colour")).agg(F.count(F.lit(1)).alias("n"))
    return rel.area_slots(counts, "image", "colour", "n", [10, 20, 30], 99).select("image", "colour", "place", "slot", "why")


@family.query("SELECT p_brand AS run, 1 + max(p_size) AS following FROM (SELECT p_brand, CASE WHEN p_size % 3 <> 0 THEN p_size ELSE 0 END AS p_size FROM part) GROUP BY 1")
def next_candidate_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("candidate_"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(".svg"))).otherwise(F.concat(F.lit("note_"), F.col("p_size")))
    return rel.next_index(load(spark, sf_dir, "part").select(F.col("p_brand").alias("run"), name.alias("file")), "run", "file")


@family.query(f"WITH {_FOLD} SELECT count(*) FILTER (action > 0) AS picks, count(DISTINCT CASE WHEN action <> 0 THEN job END) AS signal_jobs FROM fold")
def signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lrn.signal_counts(lrn.fold_events(event_log(spark, sf_dir)))


@family.query(
    f"WITH {_FOLD}, c AS (SELECT CAST(p_partkey % 60 AS VARCHAR) AS sha, max(p_partkey) AS last FROM part GROUP BY 1) SELECT job, f.sha, action, last AS candidate FROM fold f LEFT JOIN c USING (sha)"
)
def events_with_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with the candidate of their digest, the one recorded last."""
    parts = load(spark, sf_dir, "part").select((F.col("p_partkey") % 60).cast("string").alias("svg_sha"), F.col("p_partkey").alias("ord"))
    joined = lrn.observed_candidates(lrn.fold_events(event_log(spark, sf_dir)), parts)
    return joined.select("job", F.col("svg_sha").alias("sha"), F.col("action").cast("long").alias("action"), F.col("candidate.ord").alias("candidate"))


@family.query(
    """WITH l AS (SELECT o_orderkey AS k, o_orderkey % 12 AS m FROM orders)
SELECT k, CASE WHEN m = 0 THEN 1 WHEN m = 1 THEN -1 WHEN m = 2 THEN 1 WHEN m = 3 THEN -1 WHEN m = 4 THEN 1 WHEN m = 5 THEN -1 WHEN m = 6 THEN 1 WHEN m = 7 THEN -1 WHEN m = 8 THEN 1 ELSE 0 END AS action FROM l"""
)
def action_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's action out of its event, number, flag or label, the first that says something."""
    m = F.col("o_orderkey") % 12
    lines = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.when(m == 0, " STAR ").when(m == 1, "Delete").when(m.isin(2, 4), "shown").when(m == 10, "accept").alias("event"),
        F.when(m == 2, 0.5).when(m == 3, -2.0).when(m == 4, 0.0).when(m == 1, 1.0).alias("action"),
        F.when(m == 4, True).when(m == 9, False).alias("starred"), F.when(m == 5, True).alias("deleted"),
        F.when(m == 6, "style_reference ").when(m == 11, "maybe").alias("label"), F.when(m == 7, "needs_retrace").when(m == 8, "Production").alias("decision"),
    )
    return lines.select("k", rules.action_sign(dict(lines.dtypes)).cast("long").alias("action"))


@family.query(
    """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS inner_q, CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END AS outer_q FROM lineitem)
SELECT k, n, coalesce(inner_q, outer_q)::DOUBLE AS mae_art FROM l"""
)
def merged_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's readings, those of its inner block before its own."""
    n = F.col("l_linenumber")
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), n.cast("long").alias("n"), F.struct(F.when(n % 3 != 0, F.col("l_tax")).cast("double").alias("mae_art")).alias("line"), F.struct(F.when(n % 2 == 0, F.col("l_quantity")).cast("double").alias("mae_art")).alias("features"))
    return lines.select("k", "n", *lrn.merged_view("line", "features", ["mae_art"]))


@family.query(
    """WITH b AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS a, CASE WHEN l_linenumber % 3 = 0 THEN l_discount END AS b, CASE WHEN l_linenumber % 5 <> 0 THEN l_tax END AS c, l_linenumber % 4 = 0 AS m FROM lineitem)
SELECT k, n, coalesce(a, b, c)::DOUBLE AS hard, coalesce(CASE WHEN m THEN a END, b, a, c)::DOUBLE AS mae_art, coalesce(a, b, b, c, b, c)::DOUBLE AS colours, coalesce(b, a, c, c)::DOUBLE AS speckles FROM b"""
)
def raw_feature_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings of a candidate by precedence; the artwork error counts where it was measured."""
    n = F.col("l_linenumber")
    a, b, c = F.when(n % 2 == 0, F.col("l_quantity")), F.when(n % 3 == 0, F.col("l_discount")), F.when(n % 5 != 0, F.col("l_tax"))
    named = lambda **x: F.struct(*(v.cast("double").alias(k) if k != "fidelity_measured" else v.alias(k) for k, v in x.items()))
    null = F.lit(None)
    view = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), n.cast("long").alias("n"),
        named(hard=a, layer_a_hard=b, layer_b_hard=null, advisory=a, layer_a_advisory=b, layer_b_advisory=null, node_count_max=a, fidelity_measured=n % 4 == 0, fidelity_mae_art=a, mae_art=a, declared_colors=a, rendered_ink_colors=b, speckle_count=a).alias("comparison"),
        named(node_count_max=b, mae_art=b, colours=b, color_count=b, speckle_count=b).alias("metrics"), named(node_count_max=c, color_count=c).alias("stats"),
        named(hard=c, advisory=c, node_count_max=c, mae_art=c, colours=c, speckles=c, speckle_count=c).alias("view"),
    )
    return view.select("k", "n", *lrn.raw_features("comparison", "metrics", "stats", "view")).select("k", "n", "hard", "mae_art", "colours", "speckles")


@family.query(
    """WITH c AS (SELECT l_suppkey % 16 AS f, l_partkey % 16 AS t, l_returnflag AS place FROM lineitem) SELECT f AS old, t AS new, place, count(*) AS n FROM c WHERE f <> t GROUP BY ALL"""
)
def change_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed values by old, new and place of writing."""
    pairs = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 16).alias("old"), (F.col("l_partkey") % 16).alias("new"), F.col("l_returnflag").alias("place"))
    return pairs.where("old <> new").groupBy("old", "new", "place").agg(F.count(F.lit(1)).alias("n"))


@family.query(
    """WITH r AS (SELECT o_custkey AS k, o_orderpriority[1:1] AS phase, o_totalprice AS v, o_orderkey AS ord FROM orders)
SELECT k, array_to_string(list_sort(list(DISTINCT phase)), ',') AS phases, arg_max(v, ord) AS latest FROM r GROUP BY k"""
)
def phase_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of all writers of a report, and the value of the last."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.substring("o_orderpriority", 1, 1).alias("phase"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("ord"))
    return rows.groupBy("k").agg(F.array_join(F.sort_array(F.collect_set("phase")), ",").alias("phases"), F.max_by("v", "ord").alias("latest"))


@family.query(
    """WITH r AS (SELECT p_partkey AS k, p_size % 4 AS m, 'b' || p_size AS b, 'a' || p_size AS a FROM part)
SELECT k, CASE m WHEN 0 THEN 'x,' || a ELSE CASE m WHEN 1 THEN a || ',' || b WHEN 2 THEN 'all' ELSE b END END AS csv, concat('prompt ', a, ' tags ', a, ' ', b) AS flat, CASE WHEN m = 0 THEN 'poster-candidate-' || k || '.svg' ELSE 'candidate_' || k || '.svg' END AS published FROM r"""
)
def text_normalisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists or comma strings as one string, records flattened in a fixed order, published names."""
    from quarrymill.functions import text

    m, a, b = F.col("p_size") % 4, F.concat(F.lit("a"), F.col("p_size")), F.concat(F.lit("b"), F.col("p_size"))
    listed = F.when(m == 1, F.array(F.concat(F.lit(" "), a), F.lit(" "), b)).when(m == 3, F.array(b))
    name = F.concat(F.lit("candidate_"), F.col("p_partkey"), F.lit(".svg"))
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), text.csv(F.when(m == 0, F.concat(F.lit("x,"), a)), listed, "all").alias("csv"),
        text.flattened({"prompt": a}, {"tags": F.array(b, a)}).alias("flat"), text.published(F.when(m == 0, "poster").otherwise(""), name).alias("published"),
    )


@family.query(
    """SELECT o_custkey % 10 AS run, count(*) AS asked, count(*) FILTER (o_orderkey % 3 = 0) AS written, count(*) FILTER (o_orderkey % 3 = 1) AS skipped, count(*) FILTER (o_orderkey % 3 = 2) AS faults, count(*) FILTER (o_orderkey % 3 = 0) > 0 AS dataset FROM orders GROUP BY 1"""
)
def dataset_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run's variants: written, not applicable, faulty; a run of skipped ones only has no dataset."""
    k = F.col("o_orderkey")
    view = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("run"), (k % 3 != 1).alias("applicable"), F.when(k % 3 == 2, "broken").alias("fault"))
    return rules.dataset_outcomes(view, "run")


@family.query()
def rank_with_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of a run in the order of a cold ranker, with exploratory places."""
    view = record_view(spark, sf_dir).select(F.floor(F.col("id") / 40).alias("job"), "id", (F.col("id") % 3).alias("hard"), (F.col("id") % 4).alias("advisory"), F.when(F.col("id") % 5 != 0, F.col("id") % 9).cast("double").alias("mae_art"))
    return lrn.rank_with_slots(view, "job", "id", {"kind": "cold"}, slots=2)


#: Specification texts, and below in the SQL what each says.
SPECS = (
    "{\"max_colors\": 4, \"geometry\": {\"allow_open_paths\": true, \"min_stroke_width_pt\": \"0.75\"}, \"print_method\": \" Vinyl \"}", "{\"print_method\": \"screen\", \"palette\": [\"red\", \"none\", \"#ABC\"], \"geometry\": {}}", "{\"print_method\": \"plotter\", \"dimensions\": {\"width_mm\": 10}, \"max_colors\": 3.9}", "[1]", "{broken",
    "{\"max_colors\": \"4.5\"}", "{\"geometry\": {\"max_nodes_per_path\": 0}}", "{\"geometry\": {\"allow_gradients\": 1, \"allow_raster_embed\": null}, \"ink_limit_percent\": 280}", "{\"geometry\": [], \"max_colors\": -1}", "{\"dimensions\": {\"width_mm\": \"wide\"}}", "{\"palette\": [\"none\"], \"max_colors\": true}",
)


@family.query(
    """WITH k AS (SELECT c_custkey % 11 AS k, count(*) AS n FROM customer GROUP BY 1)
SELECT n, CASE k WHEN 3 THEN 'not an object' WHEN 4 THEN 'not JSON' WHEN 5 THEN 'max_colors' WHEN 6 THEN 'max_nodes_per_path' WHEN 8 THEN 'geometry' WHEN 9 THEN 'dimensions.width_mm' END AS problem,
  CASE WHEN k IN (0, 1) THEN true WHEN k IN (2, 7, 10) THEN false END AS allow_open,
  CASE k WHEN 0 THEN 'geometry.allow_open_paths' WHEN 1 THEN 'print_method=screen tolerates open strokes' WHEN 2 THEN 'print_method=plotter requires closed outlines' WHEN 7 THEN 'default (neither allow_open_paths nor print_method given)' WHEN 10 THEN 'default (neither allow_open_paths nor print_method given)' END AS open_source,
  CASE WHEN k = 0 THEN true WHEN k IN (1, 2, 7, 10) THEN false END AS contradiction, CASE WHEN k = 7 THEN true WHEN k IN (0, 1, 2, 10) THEN false END AS allow_gradients,
  CASE WHEN k = 7 THEN 'geometry.allow_raster_embed' WHEN k IN (0, 1, 2, 10) THEN 'default (geometry.allow_raster_embed is not set)' END AS raster_source,
  CASE WHEN k = 0 THEN 0.75 WHEN k IN (1, 2, 7, 10) THEN 0 END::DOUBLE AS min_stroke_pt, CASE k WHEN 0 THEN 4 WHEN 2 THEN 3 WHEN 10 THEN 1 END::BIGINT AS max_colors, CASE WHEN k = 1 THEN '#ff0000,#aabbcc' END AS palette, CASE WHEN k = 2 THEN 10 END::DOUBLE AS width_mm, CASE WHEN k = 7 THEN 280 END::DOUBLE AS ink_limit FROM k"""
)
def resolved_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings with their origin, of every customer's specification; faulty ones say why."""
    from quarrymill.operators.specs import resolved_specs as resolve

    texts = F.get(F.array(*map(F.lit, SPECS)), (F.col("c_custkey") % len(SPECS)).cast("int"))
    found = resolve(load(spark, sf_dir, "customer").select(texts.alias("spec")), "spec")
    columns = ("problem", "allow_open", "open_source", "contradiction", "allow_gradients", "raster_source", "min_stroke_pt", "max_colors", "palette", "width_mm", "ink_limit")
    found = found.withColumn("palette", F.array_join("palette", ","))
    return found.groupBy("spec", *columns).agg(F.count(F.lit(1)).alias("n")).select("n", *columns)
