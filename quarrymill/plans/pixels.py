"""Colour, pixel and plate analytics over line items as pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.functions import colour
from quarrymill.operators import pixels as px
from quarrymill.operators import relations as rel
from quarrymill.plans.registry import Family
from quarrymill.tables import load

family = Family()

INK_AREA_PERCENT = 0.05

PALETTE = [(0, 0, 0), (255, 255, 255), (200, 30, 30), (30, 200, 30), (30, 30, 200), (128, 128, 128)]
_PIX = "pix AS (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS r, (l_orderkey * 7) % 256 AS g, (l_linenumber * 36) % 256 AS b, l_quantity, l_discount, l_tax, l_extendedprice FROM lineitem)"
_GRID = "grid AS (SELECT image, y, x, max(v) AS v FROM (SELECT l_suppkey % 4 AS image, l_orderkey % 64 AS y, l_partkey % 64 AS x, l_linenumber % 3 AS v FROM lineitem) GROUP BY ALL)"


def pixel_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem")
    channel = lambda c: (c % 256).cast("long")
    return items.select(
        "l_orderkey", "l_linenumber", channel(F.col("l_partkey")).alias("r"), channel(F.col("l_orderkey") * 7).alias("g"),
        channel(F.col("l_linenumber") * 36).alias("b"), "l_quantity", "l_discount", "l_tax", "l_extendedprice",
    )


def grid_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem")
    cell = [(F.col("l_suppkey") % 4).alias("image"), (F.col("l_orderkey") % 64).alias("y"), (F.col("l_partkey") % 64).alias("x")]
    return items.groupBy(*cell).agg(F.max(F.col("l_linenumber") % 3).cast("long").alias("v"))


@family.query(
    f"WITH {_PIX}, h AS (SELECT r * 65536 + g * 256 + b AS rgb, count(*) AS n FROM pix GROUP BY 1)"
    " SELECT rgb, n, round(n / sum(n) OVER ()::DOUBLE, 9) AS share, round(sum(n) OVER (ORDER BY n DESC, rgb ROWS UNBOUNDED PRECEDING) / sum(n) OVER ()::DOUBLE, 9) AS cumulative FROM h"
)
def colour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = rel.running_share(px.histogram(pixel_view(spark, sf_dir)), "n", [F.col("n").desc(), F.col("rgb")])
    return shares.select("rgb", "n", F.round("share", 9).alias("share"), F.round("cumulative", 9).alias("cumulative"))


@family.query(
    f"WITH {_PIX}, h AS (SELECT r * 65536 + g * 256 + b AS rgb, count(*) AS n FROM pix GROUP BY 1), c AS (SELECT n, row_number() OVER w AS rn, sum(n) OVER (ORDER BY n DESC, rgb ROWS UNBOUNDED PRECEDING) / sum(n) OVER ()::DOUBLE AS cum, n / sum(n) OVER ()::DOUBLE AS share FROM h WINDOW w AS (ORDER BY n DESC, rgb))"
    " SELECT count(*) AS colours, round(max(share), 9) AS top_share, min(CASE WHEN cum >= 0.95 THEN rn END) AS colours_at_95 FROM c"
)
def colours_to_95(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("n").desc(), F.col("rgb")]
    shares = rel.running_share(px.histogram(pixel_view(spark, sf_dir)), "n", order)
    return shares.agg(F.count(F.lit(1)).alias("colours"), F.round(F.max("share"), 9).alias("top_share"), F.min(F.when(F.col("cumulative") >= 0.95, F.col("rn"))).alias("colours_at_95"))


@family.query(
    f"WITH {_PIX}, p(i, pr, pg, pb) AS (VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(PALETTE)) + "),"
    " d AS (SELECT r, g, b, arg_min(i, ((r - pr) ** 2 + (g - pg) ** 2 + (b - pb) ** 2) * 10 + i) AS entry FROM (SELECT DISTINCT r, g, b FROM pix), p GROUP BY ALL)"
    " SELECT r, g, b, CAST(entry AS BIGINT) AS entry, count(*) AS n FROM pix JOIN d USING (r, g, b) GROUP BY ALL"
)
def nearest_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = pixel_view(spark, sf_dir)
    found = view.select("r", "g", "b", px.nearest_palette(F.col("r"), F.col("g"), F.col("b"), PALETTE).cast("long").alias("entry"))
    return found.groupBy("r", "g", "b", "entry").agg(F.count(F.lit(1)).alias("n"))


@family.query(
    f"WITH {_PIX}, p(i, cr, cg, cb) AS (VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(PALETTE)) + "),"
    " h AS (SELECT r, g, b, count(*) AS n FROM pix GROUP BY ALL)"
    " SELECT i AS colour, CAST(sum(n) AS BIGINT) AS weight, count(*) AS shades FROM h JOIN p ON abs(r - cr) <= 16 AND abs(g - cg) <= 16 AND abs(b - cb) <= 16 GROUP BY i"
)
def band_join_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = pixel_view(spark, sf_dir).groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    colours = spark.createDataFrame([(i, *c) for i, c in enumerate(PALETTE)], "colour long, cr long, cg long, cb long")
    return px.band_join(hist, colours).groupBy("colour").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("shades"))


@family.query(f"WITH {_PIX}, h AS (SELECT r, g, b, count(*) AS n FROM pix GROUP BY ALL) SELECT r, g, b, n FROM h WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size * 5 = r AND p_partkey % 256 = g)")
def off_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = pixel_view(spark, sf_dir).groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    known = load(spark, sf_dir, "part").select((F.col("p_size") * 5).cast("long").alias("r"), (F.col("p_partkey") % 256).alias("g")).distinct()
    return hist.join(known, ["r", "g"], "left_anti").select("r", "g", "b", "n")


@family.query(
    f"WITH {_PIX}, c AS (SELECT l_linenumber AS image, unnest([abs(r - g), abs(g - b), abs(b - r)]) AS d, r > 40 AS art FROM pix),"
    " w AS (SELECT l_linenumber AS image, round(avg((greatest(abs(r - g), abs(g - b), abs(b - r)) < 10)::INT), 6) AS within10 FROM pix GROUP BY 1)"
    " SELECT image, round(avg(d), 6) AS mae, round(quantile_cont(d, 0.95), 6) AS p95, round(avg(d) FILTER (art), 6) AS mae_art, within10 FROM c JOIN w USING (image) GROUP BY image, within10"
)
def fidelity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = F.array(F.abs(F.col("r") - F.col("g")), F.abs(F.col("g") - F.col("b")), F.abs(F.col("b") - F.col("r")))
    channels = pixel_view(spark, sf_dir).select(F.col("l_linenumber").alias("image"), deltas.alias("deltas"), (F.col("r") > 40).alias("artwork"))
    return px.fidelity(channels, "image")


@family.query(f"WITH {_PIX} SELECT l_linenumber AS image, min(r) AS modal FROM (SELECT l_linenumber, r, count(*) AS n, max(count(*)) OVER (PARTITION BY l_linenumber) AS m FROM pix GROUP BY 1, 2) WHERE n = m GROUP BY 1")
def modal_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value, the smallest on a tie, from counts."""
    counts = pixel_view(spark, sf_dir).groupBy(F.col("l_linenumber").alias("image"), "r").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("image").agg(F.max_by("r", F.struct("n", -F.col("r"))).alias("modal"))


@family.query(
    f"WITH {_PIX}, t AS (SELECT l_linenumber AS image, l_quantity * 2 + l_discount * 1000 + l_tax * 1000 AS tac FROM pix)"
    " SELECT image, round(max(tac), 6) AS tac_max, round(avg(tac), 6) AS tac_mean, round(avg((tac > 200)::INT), 6) AS over FROM t GROUP BY image"
)
def coverage_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tac = F.col("l_quantity") * 2 + F.col("l_discount") * 1000 + F.col("l_tax") * 1000
    view = pixel_view(spark, sf_dir).select(F.col("l_linenumber").alias("image"), tac.alias("tac"))
    return view.groupBy("image").agg(F.round(F.max("tac"), 6).alias("tac_max"), F.round(F.avg("tac"), 6).alias("tac_mean"), F.round(F.avg((F.col("tac") > 200).cast("double")), 6).alias("over"))


@family.query(
    f"WITH {_PIX}, h AS (SELECT l_linenumber AS image, r, count(*) AS n FROM pix GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY image)::DOUBLE AS share FROM h)"
    " SELECT image, count(*) FILTER (share < 0.004) AS diffuse, round(coalesce(sum(share) FILTER (share < 0.004), 0), 6) AS mass FROM s GROUP BY image"
)
def diffuse_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = pixel_view(spark, sf_dir).groupBy(F.col("l_linenumber").alias("image"), "r").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("image"))
    small = F.col("share") < 0.004
    return counts.withColumn("share", share).groupBy("image").agg(F.count_if(small).alias("diffuse"), F.round(F.coalesce(F.sum(F.when(small, F.col("share"))), F.lit(0.0)), 6).alias("mass"))


_NEAR = "n AS (SELECT g.*, l.v AS vl, r.v AS vr, u.v AS vu, d.v AS vd FROM grid g LEFT JOIN grid l ON l.image = g.image AND l.y = g.y AND l.x = g.x - 1 LEFT JOIN grid r ON r.image = g.image AND r.y = g.y AND r.x = g.x + 1 LEFT JOIN grid u ON u.image = g.image AND u.x = g.x AND u.y = g.y - 1 LEFT JOIN grid d ON d.image = g.image AND d.x = g.x AND d.y = g.y + 1)"


@family.query(f"WITH {_GRID}, {_NEAR} SELECT image, round(avg(abs(vl + vr + vu + vd - 4 * v)), 6) AS energy, count(vl + vr + vu + vd) AS pixels FROM n GROUP BY image")
def laplacian_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.laplacian_energy(grid_view(spark, sf_dir), "v", "image")


@family.query(f"WITH {_GRID}, {_NEAR} SELECT image, v, bool_or(coalesce(vl = v AND vr = v AND vu = v AND vd = v, false)) AS has_interior, count(*) AS pixels FROM n GROUP BY image, v")
def interior_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.interior(grid_view(spark, sf_dir), "v", "image")


def inks(hist: DataFrame) -> DataFrame:
    """Colours that cover at least ``INK_AREA_PERCENT`` of their image."""
    area = F.sum("n").over(Window.partitionBy("image"))
    return hist.where("n > 0").withColumn("area", area).where(100 * F.col("n") >= INK_AREA_PERCENT * F.col("area")).drop("area")


@family.query()
def gap_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.blob_sizes(grid_view(spark, sf_dir).where("v = 2"), "image")


@family.query(
    f"WITH {_PIX} SELECT (r // 4) AS cr, (g // 4) AS cg, (b // 4) AS cb, count(*) AS n FROM pix GROUP BY ALL"
)
def coarse_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.coarse_histogram(pixel_view(spark, sf_dir)).select("cr", "cg", "cb", "n")


@family.query(
    f"WITH {_PIX}, q AS (SELECT DISTINCT r, g, b FROM pix) SELECT printf('#%02x%02x%02x', r, g, b) AS hex, printf('#%02x%02x%02x', 255 - r, 255 - g, 255 - b) AS inverse, printf('#%02x%02x%02x', b, r, g) AS swapped,"
    " round(sqrt(r * r + g * g + b * b), 6) AS from_black,"
    " round(0.2126 * CASE WHEN r / 255.0::DOUBLE <= 0.03928 THEN r / 255.0::DOUBLE / 12.92 ELSE ((r / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 END + 0.7152 * CASE WHEN g / 255.0::DOUBLE <= 0.03928 THEN g / 255.0::DOUBLE / 12.92 ELSE ((g / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 END + 0.0722 * CASE WHEN b / 255.0::DOUBLE <= 0.03928 THEN b / 255.0::DOUBLE / 12.92 ELSE ((b / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 END, 6) AS luminance FROM q"
)
def colour_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = pixel_view(spark, sf_dir).select("r", "g", "b").distinct()
    q = q.select("r", "g", "b", colour.to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"))
    black = colour.distance([F.col("r"), F.col("g"), F.col("b")], [F.lit(0)] * 3)
    return q.select(
        "hex", colour.invert(F.col("hex")).alias("inverse"), colour.swap_channels(F.col("hex")).alias("swapped"),
        F.round(black, 6).alias("from_black"), F.round(colour.luminance(F.col("r"), F.col("g"), F.col("b")), 6).alias("luminance"),
    )


@family.query(
    f"WITH {_PIX}, v AS (SELECT l_linenumber AS image, r, g AS before, CASE WHEN r % 10 = 0 THEN b ELSE g END AS after FROM pix)"
    " SELECT image, round(avg((before <> after)::INT), 6) AS changed, count(*) FILTER (before < 128 AND after >= 128) AS lost, count(*) FILTER (before >= 128 AND after < 128) AS gained FROM v GROUP BY image"
)
def changed_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = pixel_view(spark, sf_dir).select(F.col("l_linenumber").alias("image"), F.col("g").alias("before"), F.when(F.col("r") % 10 == 0, F.col("b")).otherwise(F.col("g")).alias("after"))
    return view.groupBy("image").agg(
        F.round(F.avg((F.col("before") != F.col("after")).cast("double")), 6).alias("changed"),
        F.count_if((F.col("before") < 128) & (F.col("after") >= 128)).alias("lost"),
        F.count_if((F.col("before") >= 128) & (F.col("after") < 128)).alias("gained"),
    )
