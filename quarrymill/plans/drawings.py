"""Nested drawings with style sheets: selectors, cascade, scopes and the rules that rest on them.

A drawing is an order, an element one of its lines, nested as a binary heap (its nth line in line n / 2)
and numbered in document order.  The SQL walks down from the root, as the rules are stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.operators import cascade, scopes
from quarrymill.plans.registry import Family
from quarrymill.tables import load

family = Family()

#: Line number -> place in the document of a heap of seven.
PLACE = {1: 2, 2: 3, 4: 4, 5: 5, 3: 6, 6: 7, 7: 8}
TAGS = ("g", "path", "rect", "defs", "linearGradient", "stop", "clipPath", "use", "symbol", "g", "path")
FILLS = ("none", "#FF0000", "lime", "url(#n2)", "inherit", "hsl(120, 100%, 25%)", None)
STYLES = ("display:none", "opacity: 0%", "visibility:hidden", "visibility: visible", "fill: navy !important; stroke:#0f0", "fill-opacity: 0.5", None, None, None, None)
#: Sheets, and below in the SQL what each says.
SHEETS = (
    None,
    ".hot { fill: #112233 } g .hot{stroke:red !important} #n4{fill:blue} @media screen{path{fill:green}} @media print{path{stroke-width:3pt}}",
    "/* rect{fill:pink} */ g g path, defs rect { stroke: #0000ff; fill: currentColor } path.hot.big{fill:gold !important; fill: tan} rect > path {fill:black} .big{visibility:visible}",
)
_PICK = lambda values: "CASE {} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"
_EL = f"""
line AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n, min(l_partkey) AS pk, min(l_suppkey) AS sk, CAST(min(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber),
el AS (SELECT doc_id, n, n // 2 AS up, CASE n {" ".join(f"WHEN {n} THEN {p}" for n, p in PLACE.items())} END AS node_id, {_PICK(TAGS).format(f"pk % {len(TAGS)}")} AS tag, 'n' || n AS id, sk % 3 <> 2 AS hot, sk % 3 = 1 AS big,
  {_PICK(FILLS).format(f"sk % {len(FILLS)}")} AS fill, CASE WHEN n % 3 = 0 THEN '#00f' END AS stroke, CASE doc_id % 4 WHEN 0 THEN '0.5pt' WHEN 1 THEN '2' END AS sw, q % {len(STYLES)} AS st, doc_id % 3 AS sheet,
  CASE WHEN n = 1 THEN 'teal' END AS color, CASE WHEN n % 2 = 1 THEN 'currentColor' ELSE '#ABC' END AS stop, n = 3 AS scaled FROM line),
asked AS (SELECT DISTINCT doc_id, 'n2' AS id FROM el WHERE fill = 'url(#n2)' UNION SELECT DISTINCT doc_id, 'n4' FROM el WHERE tag = 'use')"""


def _of(values: tuple, at: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), at.cast("int"))


def _attributes(n: Column, doc: Column, sk: Column, q: Column, tag: Column) -> dict[str, Column]:
    """The attributes of a drawing's nth line."""
    found = {
        "id": F.concat(F.lit("n"), n), "class": F.when(sk % 3 == 1, F.lit("hot  big")).when(sk % 3 == 0, F.lit("Hot")), "fill": _of(FILLS, sk % len(FILLS)), "stroke": F.when(n % 3 == 0, F.lit("#00f")),
        "stroke-width": F.when(doc % 4 == 0, F.lit("0.5pt")).when(doc % 4 == 1, F.lit("2")), "style": _of(STYLES, q.cast("int") % len(STYLES)),
        "color": F.when(n == 1, F.lit("teal")), "stop-color": F.when(n % 2 == 1, F.lit("currentColor")).otherwise(F.lit("#ABC")), "href": F.when(tag == "use", F.lit("#n4")), "transform": F.when(n == 3, F.lit("Scale(2)")),
    }
    return {name: value.cast("string") for name, value in found.items()}


def _places(n: Column) -> tuple[Column, Column]:
    """Where the nth line and its parent stand in the document."""
    place = F.create_map(*[F.lit(x) for p in PLACE.items() for x in p])
    up = F.when(n == 1, F.lit(0)).otherwise(F.try_element_at(place, F.floor(n / 2).cast("int")))
    return F.try_element_at(place, n).cast("long"), up.cast("long")


def nested_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawings as a table of elements with the text of their sheets."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")))
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    n, tag = F.col("n"), _of(TAGS, F.col("l_partkey") % len(TAGS))
    pair = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), value.alias("value")))
    values = [pair(name, value) for name, value in _attributes(n, F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_quantity"), tag).items()]
    node, up = _places(n)
    own = lines.select(F.col("l_orderkey").alias("doc_id"), node.alias("node_id"), up.alias("parent_id"), F.lit(0).alias("ord"), F.floor(F.log2(n)).cast("int").alias("depth"), tag.alias("tag"), F.map_from_entries(F.array_compact(F.array(*values))).alias("attrs"), F.lit(None).cast("string").alias("text"))
    top = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    none = F.create_map().cast("map<string,string>")
    roots = top.select("doc_id", F.lit(0).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("ord"), F.lit(-2).alias("depth"), F.lit("svg").alias("tag"), none.alias("attrs"), F.lit(None).cast("string").alias("text"))
    sheets = top.select("doc_id", F.lit(1).cast("long").alias("node_id"), F.lit(0).cast("long").alias("parent_id"), F.lit(0).alias("ord"), F.lit(-1).alias("depth"), F.lit("style").alias("tag"), none.alias("attrs"), _of(SHEETS, F.col("doc_id") % 3).alias("text"))
    return own.unionByName(roots).unionByName(sheets)


def plain_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table with a column for each attribute (``@name``), its numbers dealt by document once
    and spelled out where they are read."""
    wanted = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(2).alias("part"), *wanted)
    top = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("part"), *(F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in wanted))
    rows = lines.unionByName(top).repartition("doc_id").groupBy("doc_id", "part", "l_linenumber").agg(*(F.min(c).alias(c) for c in wanted[1:]))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("l_linenumber")))
    # an order is a root and its sheet
    rows = rows.withColumn("part", F.explode(F.when(F.col("part") == 2, F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))))
    line, root, n = F.col("part") == 2, F.col("part") == 0, F.col("n")
    tag = F.when(line, _of(TAGS, F.col("l_partkey") % len(TAGS))).when(root, F.lit("svg")).otherwise(F.lit("style"))
    node, up = _places(n)
    values = _attributes(n, F.col("doc_id"), F.col("l_suppkey"), F.col("l_quantity"), tag)
    text = F.when(F.col("part") == 1, _of(SHEETS, F.col("doc_id") % 3))
    return rows.select("doc_id", F.when(line, node).otherwise(F.col("part").cast("long")).alias("node_id"), F.when(line, up).when(~root, F.lit(0).cast("long")).alias("parent_id"), tag.alias("tag"), text.alias("text"), *(F.when(line, v).alias(f"@{a}") for a, v in values.items()))


def drawn(spark: SparkSession, sf_dir: str, **wanted) -> DataFrame:
    return scopes.drawn(nested_view(spark, sf_dir), **wanted, plain=plain_view(spark, sf_dir))


#: What the sheets say of an element: in_g, in_gg, in_defs are whether such elements stand above it.
_CSS = """
css AS (SELECT w.*,
  CASE WHEN st = 4 THEN 'navy' WHEN sheet = 1 AND id = 'n4' THEN 'blue' WHEN sheet = 1 AND hot THEN '#112233' WHEN sheet = 2 AND tag = 'path' AND big THEN 'tan'
       WHEN sheet = 2 AND (tag = 'path' AND in_gg OR tag = 'rect' AND in_defs) THEN 'currentColor' ELSE fill END AS c_fill,
  CASE WHEN sheet = 1 AND hot AND in_g THEN 'red' WHEN st = 4 THEN '#0f0' WHEN sheet = 2 AND (tag = 'path' AND in_gg OR tag = 'rect' AND in_defs) THEN '#0000ff' ELSE stroke END AS c_stroke,
  CASE WHEN sheet = 1 AND tag = 'path' THEN '3pt' ELSE sw END AS c_sw,
  CASE WHEN st = 2 THEN 'hidden' WHEN st = 3 OR sheet = 2 AND big THEN 'visible' END AS c_vis
  FROM walk w)"""
_ABOVE = """
walk AS (SELECT e.*, 0 AS gs, false AS in_g, false AS in_gg, false AS in_defs FROM el e WHERE n = 1
  UNION ALL SELECT e.*, p.gs + (p.tag = 'g')::INT, p.gs + (p.tag = 'g')::INT >= 1, p.gs + (p.tag = 'g')::INT >= 2, p.in_defs OR p.tag = 'defs' FROM el e JOIN walk p ON p.doc_id = e.doc_id AND p.n = e.up AND e.n > 1)"""
_FALL = """
fall AS (SELECT c.*, nullif(c_fill, 'inherit') AS i_fill, c_stroke AS i_stroke, c_sw AS i_sw, color AS i_color, CASE WHEN st = 5 THEN 0.5 END AS i_fo, coalesce(c_vis, 'visible') AS vis, scaled AS sc,
    CASE WHEN st IN (0, 1) THEN 'hidden' WHEN tag = 'clipPath' THEN 'inert' WHEN a.id IS NOT NULL THEN 'painted' WHEN tag = 'linearGradient' THEN 'resource' WHEN tag IN ('defs', 'symbol') THEN 'unchecked' ELSE 'painted' END AS box
  FROM css c LEFT JOIN asked a ON a.doc_id = c.doc_id AND a.id = c.id WHERE c.n = 1
  UNION ALL
  SELECT c.*, coalesce(nullif(c.c_fill, 'inherit'), p.i_fill), coalesce(c.c_stroke, p.i_stroke), coalesce(c.c_sw, p.i_sw), coalesce(c.color, p.i_color), coalesce(CASE WHEN c.st = 5 THEN 0.5 END, p.i_fo), coalesce(c.c_vis, p.vis), c.scaled OR p.sc,
    CASE WHEN p.box IN ('hidden', 'inert') THEN p.box WHEN c.st IN (0, 1) THEN 'hidden' WHEN c.tag = 'clipPath' THEN 'inert' WHEN a.id IS NOT NULL THEN 'painted' WHEN c.tag = 'linearGradient' THEN 'resource' WHEN c.tag IN ('defs', 'symbol') THEN 'unchecked' ELSE p.box END
  FROM css c JOIN fall p ON p.doc_id = c.doc_id AND p.n = c.up AND c.n > 1 LEFT JOIN asked a ON a.doc_id = c.doc_id AND a.id = c.id),
done AS (SELECT *, CASE WHEN vis = 'hidden' THEN 'hidden' ELSE box END AS scope FROM fall)"""
_ALL = f"WITH RECURSIVE {_EL}, {_ABOVE}, {_CSS}, {_FALL}"
_HEX = "CASE lower({0}) WHEN 'none' THEN NULL WHEN 'url(#n2)' THEN NULL WHEN 'lime' THEN '#00ff00' WHEN 'hsl(120, 100%, 25%)' THEN '#008000' WHEN 'red' THEN '#ff0000' WHEN 'blue' THEN '#0000ff' WHEN 'navy' THEN '#000080' WHEN 'tan' THEN '#d2b48c' WHEN '#00f' THEN '#0000ff' WHEN '#0f0' THEN '#00ff00' WHEN '#abc' THEN '#aabbcc' WHEN 'currentcolor' THEN CASE i_color WHEN 'teal' THEN '#008080' ELSE '#000000' END ELSE lower({0}) END"


@family.query(
    f"""{_ALL} SELECT selector, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (
  SELECT doc_id, unnest(list_filter([CASE WHEN sheet = 1 AND hot THEN '.hot' END, CASE WHEN sheet = 1 AND hot AND in_g THEN 'g .hot' END, CASE WHEN sheet = 1 AND id = 'n4' THEN '#n4' END, CASE WHEN sheet = 1 AND tag = 'path' THEN 'path' END, CASE WHEN sheet = 2 AND tag = 'path' AND in_gg THEN 'g g path' END,
    CASE WHEN sheet = 2 AND tag = 'rect' AND in_defs THEN 'defs rect' END, CASE WHEN sheet = 2 AND tag = 'path' AND big THEN 'path.hot.big' END, CASE WHEN sheet = 2 AND big THEN '.big' END, CASE WHEN sheet = 2 AND tag = 'path' AND (SELECT p.tag FROM el p WHERE p.doc_id = css.doc_id AND p.n = css.up) = 'rect' THEN 'rect > path' END], lambda x: x IS NOT NULL)) AS selector FROM css) GROUP BY selector"""
)
def selector_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements each selector selects, those of children included."""
    from quarrymill.scratch import written

    view = written(nested_view(spark, sf_dir), "elements")
    rules = written(cascade.style_rules(view.where("tag = 'style'")), "rules")
    found = cascade.selector_matches(rules, view, " >+~").join(rules.select("doc_id", "rule", "selector").distinct().hint("merge"), ["doc_id", "rule"])
    return found.groupBy("selector").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


@family.query(
    f"""{_ALL} SELECT fill, source, count(*) AS n FROM (SELECT c_fill AS fill, CASE WHEN st = 4 THEN 'style' WHEN sheet = 1 AND (id = 'n4' OR hot) OR sheet = 2 AND (tag = 'path' AND (big OR in_gg) OR tag = 'rect' AND in_defs) THEN 'css' WHEN fill IS NOT NULL THEN 'attr' END AS source FROM css) WHERE fill IS NOT NULL GROUP BY ALL"""
)
def cascaded_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fills that win the cascade, and where they come from."""
    found = cascade.cascaded(nested_view(spark, sf_dir)).select(F.try_element_at("style", F.lit("fill")).alias("x")).where("x IS NOT NULL")
    return found.groupBy(F.col("x.value").alias("fill"), F.col("x.source").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@family.query(f"{_ALL} SELECT doc_id, node_id, scope, i_fill AS fill, i_stroke AS stroke FROM done")
def nested_paint_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each element's scope, and the fill and stroke in force."""
    return drawn(spark, sf_dir, passed=("fill", "stroke")).where("node_id > 1").select("doc_id", "node_id", "scope", "fill", "stroke")


_SHAPE = "tag IN ('path', 'rect', 'use')"


@family.query(
    f"""{_ALL} SELECT doc_id, count(*) AS colours FROM (SELECT DISTINCT doc_id, colour FROM (
  SELECT doc_id, {_HEX.format("stop")} AS colour FROM done WHERE scope IN ('painted', 'resource') AND tag = 'stop'
  UNION ALL SELECT doc_id, CASE WHEN i_fill IS NULL THEN '#000000' ELSE {_HEX.format("i_fill")} END FROM done WHERE scope = 'painted' AND {_SHAPE}
  UNION ALL SELECT doc_id, {_HEX.format("i_stroke")} FROM done WHERE scope = 'painted' AND {_SHAPE}) WHERE colour IS NOT NULL) GROUP BY doc_id HAVING count(*) > 2"""
)
def nested_color_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings that ink in more than two colours."""
    found = scopes.inks(drawn(spark, sf_dir, kept=scopes.INKED, **scopes.INKS)).select("doc_id", "colour").distinct()
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("colours")).where("colours > 2")


@family.query(
    f"""{_ALL} SELECT doc_id, node_id, points FROM (SELECT doc_id, node_id, CASE coalesce(i_sw, '1') WHEN '0.5pt' THEN 0.5 WHEN '2' THEN 1.5 WHEN '3pt' THEN 3.0 ELSE 0.75 END::DOUBLE AS points FROM done WHERE scope = 'painted' AND {_SHAPE} AND i_stroke IS NOT NULL) WHERE points < 1.6"""
)
def nested_stroke_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes below 1.6 points that reach the sheet."""
    from quarrymill.functions import numeric

    found = scopes.strokes(drawn(spark, sf_dir, kept=scopes.STROKED, **scopes.STROKES))
    return found.select("doc_id", "node_id", F.round(numeric.length_points(F.col("width")), 6).alias("points")).where("points < 1.6")


@family.query(
    f"""{_ALL} SELECT rule, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (
  SELECT doc_id, 'UNCHECKED_DEFINITION' AS rule FROM done WHERE scope = 'unchecked' AND {_SHAPE} UNION ALL SELECT doc_id, 'TRANSLUCENT_PAINT' FROM done WHERE scope = 'painted' AND i_fo IS NOT NULL
  UNION ALL SELECT doc_id, 'STROKE_SCALE_TRANSFORM' FROM done WHERE scope = 'painted' AND {_SHAPE} AND i_stroke IS NOT NULL AND sc) GROUP BY rule"""
)
def nested_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is reported without failing."""
    found = scopes.notes(drawn(spark, sf_dir, kept=scopes.NOTED, **scopes.NOTES))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


_OWN = "concat_ws(chr(2), lower(tag), concat_ws(chr(1), CASE WHEN hot THEN 'class=' || CASE WHEN big THEN 'hot  big' ELSE 'Hot' END END, 'color=' || color, 'fill=' || fill, CASE WHEN tag = 'use' THEN 'href=#n4' END, 'id=' || id, 'stop-color=' || stop, 'stroke=' || stroke, 'stroke-width=' || sw, 'style=' || " + _PICK(STYLES).format("st") + ", CASE WHEN n = 3 THEN 'transform=Scale(2)' END), '')"
_KIDS = lambda t: f"SELECT doc_id, up, sha256(string_agg(digest, '' ORDER BY node_id)) AS kids, sum(nodes) AS below FROM {t} GROUP BY doc_id, up"
_TREE = f"""{_EL}, own AS (SELECT *, {_OWN} AS own FROM el),
low AS (SELECT doc_id, up, node_id, n, sha256(own || chr(2)) AS digest, 1 AS nodes FROM own WHERE n >= 4),
mid AS (SELECT o.doc_id, o.up, o.node_id, o.n, sha256(own || chr(2) || coalesce(kids, '')) AS digest, 1 + coalesce(below, 0) AS nodes FROM own o LEFT JOIN ({_KIDS("low")}) k ON k.doc_id = o.doc_id AND k.up = o.n WHERE o.n IN (2, 3)),
top AS (SELECT o.doc_id, o.up, o.node_id, o.n, sha256(own || chr(2) || coalesce(kids, '')) AS digest, 1 + coalesce(below, 0) AS nodes FROM own o LEFT JOIN ({_KIDS("mid")}) k ON k.doc_id = o.doc_id AND k.up = o.n WHERE o.n = 1)"""


@family.query(f"WITH {_TREE} SELECT doc_id, node_id, digest, CAST(nodes AS BIGINT) AS nodes FROM (SELECT * FROM low UNION ALL SELECT * FROM mid UNION ALL SELECT * FROM top)")
def tree_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A canonical digest of every subtree of the drawings."""
    from quarrymill.operators.canonical import tree_digests as digests

    return digests(nested_view(spark, sf_dir).where("node_id > 1"))
