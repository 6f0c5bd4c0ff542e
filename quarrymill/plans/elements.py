"""The rule catalogue over a table of elements: a line of an order is an element of its drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import elements as el
from quarrymill.plans.registry import Family
from quarrymill.tables import load

family = Family()

#: Path data, and what is to be measured of it: state, nodes, open subpaths, closes, moves.
PATHS = [
    ("M0 0 L10 0 L10 10 Z", "drawn", 3, 0, 1, 1), ("M0 0 L5 5", "drawn", 1, 1, 0, 1), ("", "empty", 0, 0, 0, 0), ("M3 3 L3 3 Z", "zero_length", 1, 0, 1, 1),
    ("m0,0 1,0 0,1 z M5 5 L9 9", "drawn", 4, 1, 1, 2), ("M0 0 L4 0 L0 0 Z", "zero_area", 2, 0, 1, 1), ("M0 0 C1 1 2 1 3 0 S5-1 6 0 A1 1 0 0 1 8 0 H0", "drawn", 4, 0, 0, 1), ("M0 0 W3", "unparseable", 0, 0, 0, 1),
]
_CASE = lambda i: " ".join(f"WHEN {k} THEN " + (f"'{row[i]}'" if isinstance(row[i], str) else str(row[i])) for k, row in enumerate(PATHS))
_EL = f"""
el AS (SELECT l_orderkey AS doc_id, l_linenumber AS node_id, CASE l_partkey % 8 WHEN 0 THEN 'image' WHEN 1 THEN 'use' WHEN 4 THEN 'rect' WHEN 5 THEN 'linearGradient' WHEN 7 THEN 'foreignObject' ELSE 'path' END AS tag,
  CASE l_suppkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN '#ff0000' WHEN 2 THEN '#00ff00' WHEN 3 THEN 'url(#n1)' WHEN 5 THEN '#abcdef' END AS fill, CASE WHEN l_linenumber % 2 = 0 THEN '#000000' WHEN l_linenumber = 5 THEN 'none' END AS stroke,
  CASE l_orderkey % 4 WHEN 0 THEN '0.5pt' WHEN 1 THEN '2' WHEN 2 THEN 'bad' END AS sw, l_partkey % 3 AS hrefs, l_suppkey % 7 = 0 AS dataimg, CAST(l_quantity AS BIGINT) % 8 AS pk
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
paths AS (SELECT doc_id, node_id, CASE pk {_CASE(1)} END AS state, CASE pk {_CASE(2)} END AS nodes, CASE pk {_CASE(3)} END AS open_subpaths, CASE pk {_CASE(4)} END AS closes, CASE pk {_CASE(5)} END AS moves FROM el WHERE tag = 'path')
"""


def element_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat drawing for each order: a root (node 0), and a child for each of its lines."""
    items = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")))
    pick = lambda x, at: F.coalesce(*(F.when(x == k, F.lit(v)) for k, v in at.items()))
    n = F.col("l_linenumber").cast("long")
    pair = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")))
    values = [
        pair("id", F.concat(F.lit("n"), n)), pair("fill", pick(F.col("l_suppkey") % 6, {0: "none", 1: "#FF0000", 2: "lime", 3: "url(#n1)", 5: "#abcdef"})),
        pair("stroke", F.when(n % 2 == 0, "#000").when(n == 5, " None")), pair("stroke-width", pick(F.col("l_orderkey") % 4, {0: "0.5pt", 1: "2", 2: "bad"})),
        pair("href", pick(F.col("l_partkey") % 3, {0: "#n2", 1: "http://x.example/y.svg"})), pair("style", F.when(F.col("l_suppkey") % 7 == 0, "background: URL( 'data:image/png;x')")),
        pair("d", F.get(F.array(*(F.lit(p[0]) for p in PATHS)), (F.col("l_quantity").cast("int") % 8))),
    ]
    tag = F.coalesce(pick(F.col("l_partkey") % 8, {0: "image", 1: "use", 4: "rect", 5: "linearGradient", 7: "foreignObject"}), F.lit("path"))
    lines = items.select(F.col("l_orderkey").alias("doc_id"), n.alias("node_id"), F.lit(0).cast("long").alias("parent_id"), (n - 1).cast("int").alias("ord"), F.lit(1).alias("depth"), tag.alias("tag"), F.map_from_entries(F.array_compact(F.array(*values))).alias("attrs"))
    k = F.col("o_orderkey")
    size = F.map_from_arrays(F.array(F.lit("width"), F.lit("height"), F.lit("viewBox")), F.array(F.when(k % 3 == 0, F.lit("100mm")).otherwise(F.lit("auto")), F.when(k % 2 == 0, F.lit("50mm")).otherwise(F.lit("10%")), F.when(k % 5 == 0, F.lit("0 0")).otherwise(F.lit("0 0 378 189"))))
    roots = load(spark, sf_dir, "orders").select(k.alias("doc_id"), F.lit(0).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("ord"), F.lit(0).alias("depth"), F.lit("svg").alias("tag"), size.alias("attrs"))
    return roots.unionByName(lines)


@family.query(
    f"""WITH {_EL} SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (
  SELECT doc_id, unnest(list_filter([CASE WHEN tag = 'image' THEN 'image' WHEN tag = 'foreignObject' THEN 'foreignObject' WHEN tag = 'use' AND hrefs = 1 THEN 'use' END, CASE WHEN dataimg THEN 'style url()' END], lambda x: x IS NOT NULL)) AS kind FROM el) GROUP BY kind"""
)
def rule_raster_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = el.raster_sources(element_view(spark, sf_dir))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


_COLOURS = """painted AS (SELECT doc_id, unnest(list_filter([CASE fill WHEN 'none' THEN NULL WHEN 'url(#n1)' THEN NULL ELSE coalesce(fill, '#000000') END, nullif(stroke, 'none')], lambda x: x IS NOT NULL)) AS colour FROM el WHERE tag IN ('use', 'rect', 'path')),
force AS (SELECT doc_id, colour, count(*) AS n FROM painted GROUP BY ALL)"""


@family.query(f"WITH {_EL}, {_COLOURS} SELECT doc_id, count(*) AS colours FROM force GROUP BY doc_id HAVING count(*) > 2")
def rule_color_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el.colour_count(element_view(spark, sf_dir), 2)


@family.query(f"WITH {_EL}, {_COLOURS} SELECT colour, CAST(sum(n) AS BIGINT) AS n, count(*) AS documents FROM force WHERE colour NOT IN ('#000000', '#abcdef') GROUP BY colour")
def rule_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = el.off_palette(element_view(spark, sf_dir), ["#000000", "#ABCDEF"])
    return found.groupBy("colour").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))


@family.query(f"WITH {_EL}, {_COLOURS}, t AS (SELECT colour, CAST(sum(n) AS BIGINT) AS n FROM force GROUP BY 1) SELECT colour, n, row_number() OVER (ORDER BY n DESC, colour) AS place FROM t")
def declared_colour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours, the most used first; one row for each colour in use."""
    from quarrymill.operators.relations import ranged

    total = el.colours_in_force(element_view(spark, sf_dir)).groupBy("colour").agg(F.sum("n").alias("n"))
    return ranged(total, [F.col("n").desc(), F.col("colour")], []).select("colour", "n", "place")


@family.query(
    f"WITH {_EL} SELECT kind, target, count(*) AS n FROM (SELECT 'definition' AS kind, 'n' || node_id AS target FROM el WHERE tag = 'linearGradient' UNION ALL SELECT 'fill', 'n1' FROM el WHERE fill = 'url(#n1)') GROUP BY ALL"
)
def rule_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el.gradients(element_view(spark, sf_dir)).groupBy("kind", "target").agg(F.count(F.lit(1)).alias("n"))


@family.query(
    f"""WITH {_EL}, refs AS (SELECT doc_id, 'fill' AS prop, 1 AS target FROM el WHERE fill = 'url(#n1)' UNION ALL SELECT doc_id, 'href', 2 FROM el WHERE hrefs = 0)
SELECT prop, coalesce(t.tag, 'nothing') AS kind, count(*) AS n FROM refs r LEFT JOIN el t ON t.doc_id = r.doc_id AND t.node_id = r.target GROUP BY ALL"""
)
def id_reference_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = el.id_references(element_view(spark, sf_dir))
    return found.groupBy("prop", F.coalesce("kind", F.lit("nothing")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@family.query(
    f"""WITH {_EL}, p AS (SELECT doc_id, node_id, CASE sw WHEN '0.5pt' THEN 0.5::DOUBLE WHEN '2' THEN 1.5::DOUBLE WHEN 'bad' THEN NULL ELSE 0.75::DOUBLE END AS points FROM el WHERE tag IN ('use', 'rect', 'path') AND stroke = '#000000')
SELECT doc_id, node_id, round(points, 6) AS points FROM p WHERE points IS NULL OR points < 0.76"""
)
def rule_min_stroke_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el.thin_strokes(element_view(spark, sf_dir), 0.76).select("doc_id", F.col("node_id"), F.round("points", 6).alias("points"))


@family.query(
    f"""WITH {_EL} SELECT rule, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, CASE WHEN state = 'unparseable' THEN 'PATH_PARSE_ERROR' WHEN state <> 'drawn' THEN 'ZERO_AREA_PATH' WHEN open_subpaths > 0 THEN 'OPEN_PATH' END AS rule FROM paths) WHERE rule IS NOT NULL GROUP BY rule"""
)
def rule_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = el.path_findings(el.path_table(element_view(spark, sf_dir)))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


@family.query(
    f"WITH {_EL} SELECT doc_id, count(*) AS paths, CAST(sum(nodes) AS BIGINT) AS nodes_total, max(nodes) AS nodes_max, count(*) FILTER (nodes > 2) AS over_limit, CAST(sum(closes) AS BIGINT) AS closes, CAST(sum(moves) AS BIGINT) AS moves FROM paths GROUP BY doc_id"
)
def path_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el.path_totals(el.path_table(element_view(spark, sf_dir)), 2)


@family.query(
    f"""WITH {_EL}, r AS (SELECT doc_id, node_id, nodes, row_number() OVER (PARTITION BY doc_id ORDER BY nodes DESC, node_id) AS place FROM paths WHERE nodes > 1)
SELECT doc_id, place, nodes::DOUBLE AS nodes, 1 AS rows FROM r WHERE place <= 2 UNION ALL SELECT doc_id, 3, sum(nodes)::DOUBLE, count(*) FROM r WHERE place > 2 GROUP BY doc_id"""
)
def rule_node_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths over the limit, the worst first, and one row for the others of the drawing."""
    from quarrymill.operators.relations import top_with_rest

    over = el.path_table(element_view(spark, sf_dir)).where("nodes > 1")
    return top_with_rest(over, "doc_id", [F.col("nodes").desc(), F.col("node_id")], 2, "nodes")


@family.query(
    """WITH r AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 100.0::DOUBLE WHEN o_orderkey % 5 <> 0 THEN 378 * 25.4 / 96 END AS w, CASE WHEN o_orderkey % 2 = 0 THEN 50.0::DOUBLE WHEN o_orderkey % 5 <> 0 THEN 189 * 25.4 / 96 END AS h FROM orders)
SELECT axis, count(*) AS n, round(max(actual), 3) AS most FROM (SELECT doc_id, 'width' AS axis, w AS actual FROM r WHERE w IS NOT NULL AND h IS NOT NULL AND abs(w - 100.3) > 0.29 UNION ALL SELECT doc_id, 'height', h FROM r WHERE w IS NOT NULL AND h IS NOT NULL AND abs(h - 50) > 0.29) GROUP BY axis"""
)
def rule_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = el.dimensions(element_view(spark, sf_dir), 100.3, 50.0, tolerance=0.29)
    return found.groupBy("axis").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("actual_mm"), 3).alias("most"))


@family.query(
    f"""WITH {_EL}, asked AS (SELECT DISTINCT doc_id, 1 AS node_id FROM el WHERE fill = 'url(#n1)' UNION SELECT DISTINCT doc_id, 2 FROM el WHERE hrefs = 0 AND tag = 'use')
SELECT scope, count(*) AS n FROM (SELECT CASE WHEN tag = 'linearGradient' AND a.node_id IS NULL THEN 'resource' ELSE 'painted' END AS scope FROM el LEFT JOIN asked a USING (doc_id, node_id) UNION ALL SELECT 'painted' FROM orders) GROUP BY scope"""
)
def paint_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el.paint_scopes(element_view(spark, sf_dir)).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@family.query(
    f"""WITH {_EL}, later AS (SELECT doc_id, node_id, CASE (pk + (doc_id % 5 = 0)::INT) % 8 {_CASE(4)} END AS closes, CASE (pk + (doc_id % 5 = 0)::INT) % 8 {_CASE(5)} END AS moves FROM el WHERE tag = 'path' AND doc_id % 9 <> 0),
a AS (SELECT doc_id, sum(closes) AS closes, sum(moves) AS moves FROM paths GROUP BY 1), b AS (SELECT doc_id, sum(closes) AS closes, sum(moves) AS moves FROM later GROUP BY 1)
SELECT * FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.closes, 0)::BIGINT AS closes, coalesce(b.closes, 0)::BIGINT AS closes_after, coalesce(a.moves, 0)::BIGINT AS moves, coalesce(b.moves, 0)::BIGINT AS moves_after FROM a FULL JOIN b ON a.doc_id = b.doc_id)
WHERE closes <> closes_after OR moves <> moves_after"""
)
def closure_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings that lost or gained closing or moving commands: in every fifth another path stands for each, every ninth is gone."""
    before = element_view(spark, sf_dir)
    data = F.array(*(F.lit(p[0]) for p in PATHS))
    shown = F.array_position(data, F.try_element_at("attrs", F.lit("d"))).cast("int")
    other = F.when(F.col("doc_id") % 5 == 0, F.get(data, shown % len(PATHS))).otherwise(F.try_element_at("attrs", F.lit("d")))
    later = F.map_concat(F.map_filter("attrs", lambda k, _: k != "d"), F.create_map(F.lit("d"), other))
    after = before.where("doc_id % 9 <> 0").withColumn("attrs", F.when(F.map_contains_key("attrs", "d"), later).otherwise(F.col("attrs")))
    return el.closure_changes(el.path_totals(el.path_table(before), 2), el.path_totals(el.path_table(after), 2))
