"""Rendered sheets: inks, blends, screens and tone.  A sheet is 120 orders, a row of it an order, a
pixel one of the order's lines: five stripes of 24 rows, blends where two meet, a ramp, and specks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.operators import pixels as px
from quarrymill.operators import plates
from quarrymill.plans.registry import Family
from quarrymill.tables import load

family = Family()

ROWS, STRIPE = 120, 24
INKS = [(200, 30, 30), (30, 30, 200), (255, 255, 255), (20, 160, 60), (90, 90, 90)]
AREA, MEMBERS, TONE_AREA, TONE_COLOURS = 0.4, 6, 1.0, 4
_INK = lambda c, s: f"CASE {s} " + " ".join(f"WHEN {i} THEN {ink['rgb'.index(c)]}" for i, ink in enumerate(INKS)) + " END"
_RAMP = {"r": 2, "g": 0, "b": 1}
_CHANNEL = lambda c, speck: f"CASE WHEN pk % 41 = 0 THEN {speck} WHEN y % 24 = 0 AND y > 0 THEN ({_INK(c, 'y // 24 - 1')} * 3 + {_INK(c, 'y // 24')} * 5) // 8 WHEN y >= 96 THEN 90 + {_RAMP[c]} * (y % 24 // 3) ELSE {_INK(c, 'y // 24')} END AS {c}"
_SHEET = f"""
ln AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS x, min(l_partkey) AS pk, min(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey, l_linenumber),
sheet AS (SELECT o // {ROWS} AS image, y, x, {_CHANNEL("r", "sk * 37 % 256")}, {_CHANNEL("g", "pk % 256")}, {_CHANNEL("b", "77")} FROM (SELECT *, o % {ROWS} AS y FROM ln)),
tot AS (SELECT image, count(*) AS total FROM sheet GROUP BY 1),
cnt AS (SELECT image, r, g, b, count(*) AS n, 100.0::DOUBLE * count(*) / any_value(total) AS share FROM sheet JOIN tot USING (image) GROUP BY image, r, g, b),
big AS (SELECT image, r, g, b, n, row_number() OVER (PARTITION BY image ORDER BY n DESC, r, g, b) AS place FROM cnt WHERE share >= {AREA} AND r * 65536 + g * 256 + b <> 16777215),
led AS (
  SELECT image, 0::BIGINT AS place, []::STRUCT(r BIGINT, g BIGINT, b BIGINT, place BIGINT)[] AS heads, 0::BIGINT AS leader FROM (SELECT DISTINCT image FROM big)
  UNION ALL
  SELECT image, place, CASE WHEN hit IS NULL THEN list_append(heads, {{'r': r, 'g': g, 'b': b, 'place': place}}) ELSE heads END, coalesce(hit, place) FROM (
    SELECT c.image, c.place, c.r, c.g, c.b, heads, list_filter(heads, lambda h: (h.r - c.r) * (h.r - c.r) + (h.g - c.g) * (h.g - c.g) + (h.b - c.b) * (h.b - c.b) <= 400)[1].place AS hit FROM led JOIN big c ON c.image = led.image AND c.place = led.place + 1)),
clu AS (SELECT image, row_number() OVER (PARTITION BY image ORDER BY leader) - 1 AS cluster, r, g, b, n, members, 100.0::DOUBLE * n / total AS share FROM (
  SELECT l.image, l.leader, any_value(c.r) FILTER (c.place = l.leader) AS r, any_value(c.g) FILTER (c.place = l.leader) AS g, any_value(c.b) FILTER (c.place = l.leader) AS b, sum(c.n)::BIGINT AS n, count(*) AS members FROM led l JOIN big c USING (image, place) GROUP BY l.image, l.leader) JOIN tot USING (image))"""
_FOLD = """
anc AS (SELECT image, cluster, cluster AS turn, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM clu UNION ALL SELECT DISTINCT image, -1, 1000000, 255.0, 255.0, 255.0 FROM clu),
seg AS (SELECT q.image, q.cluster, a.cluster AS a, b.cluster AS b, a.turn AS ta, b.turn AS tb, ((q.r - a.r) * (b.r - a.r) + (q.g - a.g) * (b.g - a.g) + (q.b - a.b) * (b.b - a.b)) / ((b.r - a.r) * (b.r - a.r) + (b.g - a.g) * (b.g - a.g) + (b.b - a.b) * (b.b - a.b)) AS t,
    q.r - a.r AS x, q.g - a.g AS y, q.b - a.b AS z, b.r - a.r AS u, b.g - a.g AS v, b.b - a.b AS w
  FROM anc q JOIN anc a ON a.image = q.image JOIN anc b ON b.image = q.image AND a.turn < b.turn WHERE q.cluster >= 0 AND (b.r - a.r) * (b.r - a.r) + (b.g - a.g) * (b.g - a.g) + (b.b - a.b) * (b.b - a.b) > 48.0 * 48.0),
gap AS (SELECT *, round(sqrt((x - t * u) * (x - t * u) + (y - t * v) * (y - t * v) + (z - t * w) * (z - t * w)), 9) AS gap FROM seg WHERE t > 0 AND t < 1),
best AS (SELECT image, cluster, a, b, gap FROM gap WHERE gap <= 24 QUALIFY row_number() OVER (PARTITION BY image, cluster ORDER BY gap, ta, tb) = 1),
solid AS (SELECT DISTINCT s.image, s.r, s.g, s.b FROM sheet s WHERE (SELECT count(*) FROM sheet n WHERE n.image = s.image AND n.r = s.r AND n.g = s.g AND n.b = s.b AND abs(n.x - s.x) + abs(n.y - s.y) = 1) = 4),
each AS (SELECT c.*, coalesce(best.a, -9) AS a, coalesce(best.b, -9) AS b2, solid.r IS NOT NULL AS inside FROM clu c LEFT JOIN best USING (image, cluster) LEFT JOIN solid ON solid.image = c.image AND solid.r = c.r AND solid.g = c.g AND solid.b = c.b),
fold AS (
  SELECT image, -1::BIGINT AS k, list(share ORDER BY cluster) AS shares, list(0 ORDER BY cluster) AS took, list(true ORDER BY cluster) AS kept FROM clu GROUP BY image
  UNION ALL
  SELECT image, k + 1, CASE WHEN owner IS NULL THEN shares ELSE list_transform(shares, lambda s, i: CASE WHEN i = owner + 1 THEN s + shares[k + 2] ELSE s END) END,
    CASE WHEN owner IS NULL THEN took ELSE list_transform(took, lambda s, i: CASE WHEN i = owner + 1 THEN s + 1 ELSE s END) END, CASE WHEN owner IS NULL THEN kept ELSE list_transform(kept, lambda s, i: s AND i <> k + 2) END
  FROM (SELECT f.*, CASE WHEN e.a = -9 OR took[k + 2] > 0 OR e.share > 5 OR e.inside THEN NULL WHEN e.a = -1 THEN e.b2 WHEN e.b2 = -1 OR shares[e.a + 1] >= shares[e.b2 + 1] THEN e.a ELSE e.b2 END AS owner
        FROM fold f JOIN each e ON e.image = f.image AND e.cluster = f.k + 1)),
done AS (SELECT c.image, c.cluster, c.r, c.g, c.b, f.shares[c.cluster + 1] AS share, c.members, f.took[c.cluster + 1] AS absorbed, f.kept[c.cluster + 1] AS kept
  FROM clu c JOIN (SELECT * FROM fold QUALIFY k = max(k) OVER (PARTITION BY image)) f USING (image))"""


def sheet_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets as a table of pixels ``image, y, x, r, g, b``.  Lines are dealt by sheet, which is ``ROWS``
    orders, so that what is asked of a sheet finds its pixels in one place without another shuffle."""
    dealt = load(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / ROWS).alias("image"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("image")
    lines = dealt.groupBy("image", "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"))
    x = F.row_number().over(Window.partitionBy("image", "l_orderkey").orderBy("l_linenumber")) - 1
    at = lines.select("image", (F.col("l_orderkey") % ROWS).alias("y"), x.cast("long").alias("x"), "pk", "sk")
    stripe = F.floor(F.col("y") / STRIPE)
    ink = lambda i, s: F.get(F.array(*(F.lit(c[i]) for c in INKS)), s.cast("int")).cast("long")
    shade = F.floor(F.col("y") % STRIPE / 3)

    def channel(i: int, name: str, speck):
        mixed = F.floor((ink(i, stripe - 1) * 3 + ink(i, stripe) * 5) / 8)
        return F.when(F.col("pk") % 41 == 0, speck).when((F.col("y") % STRIPE == 0) & (F.col("y") > 0), mixed).when(F.col("y") >= 4 * STRIPE, 90 + _RAMP[name] * shade).otherwise(ink(i, stripe)).cast("long").alias(name)

    return at.select("image", "y", "x", channel(0, "r", F.col("sk") * 37 % 256), channel(1, "g", F.col("pk") % 256), channel(2, "b", F.lit(77)))


@family.query(f"WITH RECURSIVE {_SHEET} SELECT image, cluster, r, g, b, n, members FROM clu")
def sheet_inks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy ink clusters of every sheet."""
    large = plates.shares(sheet_view(spark, sf_dir), "image").where((F.col("share") >= AREA) & (F.col("rgb") != plates.WHITE))
    return plates.ink_clusters(large, "image")


@family.query(f"WITH RECURSIVE {_SHEET.replace(f'share >= {AREA}', 'share >= 0.05')} SELECT image, cluster, r, g, b, n, members FROM clu")
def ink_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over every colour that covers a twentieth of a percent."""
    from quarrymill.operators import pixels

    large = plates.shares(sheet_view(spark, sf_dir), "image").where((F.col("share") >= plates.AREA_PERCENT) & (F.col("rgb") != plates.WHITE))
    return pixels.leader_clusters(large, "image")


@family.query(f"WITH RECURSIVE {_SHEET}, {_FOLD} SELECT image, cluster, a AS one, b AS two, gap FROM best")
def blend_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two anchors that each ink lies between."""
    from quarrymill.scratch import written

    return plates.blend_segments(written(sheet_inks(spark, sf_dir), "inks"), "image")


@family.query(f"WITH RECURSIVE {_SHEET}, {_FOLD} SELECT image, cluster, r, g, b, round(share, 6) AS share, members, absorbed, kept FROM done")
def sheet_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inks after boundary blends have gone to the inks they lie between."""
    return plates.plates(sheet_view(spark, sf_dir), "image", AREA).withColumn("share", F.round("share", 6))


@family.query(
    f"""WITH RECURSIVE {_SHEET}, {_FOLD}, small AS (SELECT image, coalesce(sum(share) FILTER (share < {AREA} AND r * 65536 + g * 256 + b <> 16777215), 0) AS area, count(*) FILTER (share < {AREA} AND r * 65536 + g * 256 + b <> 16777215) AS colours FROM cnt GROUP BY image),
own AS (SELECT image, count(*) AS screens, count(*) FILTER (members >= {MEMBERS}) AS ramps, arg_max(members, (share, -cluster)) FILTER (members >= {MEMBERS}) AS ramp_members FROM done WHERE kept AND share >= {AREA} GROUP BY image)
SELECT image, coalesce(screens, 0) AS screens, coalesce(ramps, 0) AS ramps, ramp_members, round(area, 6) AS diffuse_area, colours AS diffuse_colours, CASE WHEN ramps > 0 THEN 'ramp' WHEN area >= {TONE_AREA} AND colours >= {TONE_COLOURS} THEN 'diffuse' END AS arm FROM small LEFT JOIN own USING (image)"""
)
def sheet_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screens of every sheet, and whether it has continuous tone, by ramps or by diffuse colours."""
    view = sheet_view(spark, sf_dir)
    colours = plates.shares(view, "image")
    found = plates.tone(view, plates.plates(view, "image", AREA, colours=colours), "image", AREA, MEMBERS, TONE_AREA, TONE_COLOURS, colours)
    return found.withColumn("diffuse_area", F.round("diffuse_area", 6))


@family.query(
    f"""WITH RECURSIVE {_SHEET}, mark AS (SELECT image, y, x FROM sheet WHERE r > 80 AND y < 118), reach AS (
  SELECT image, y, x, y AS y0, x AS x0 FROM mark UNION SELECT r.image, m.y, m.x, r.y0, r.x0 FROM reach r JOIN mark m ON m.image = r.image AND abs(m.y - r.y) + abs(m.x - r.x) = 1),
size AS (SELECT image, head, count(*) AS n FROM (SELECT image, y0, x0, min((y, x)) AS head FROM reach GROUP BY image, y0, x0) GROUP BY image, head)
SELECT image, max(n) AS largest, count(*) AS blobs FROM size GROUP BY image"""
)
def sheet_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest 4-connected blob of reddish pixels, and how many blobs there are."""
    return px.blob_sizes(sheet_view(spark, sf_dir).where("r > 80 AND y < 118"), "image")


@family.query(
    f"""WITH {_SHEET.split("tot AS")[0].rstrip().rstrip(",")}, size AS (SELECT image, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM sheet GROUP BY 1),
ring AS (SELECT image, r, g, b FROM sheet JOIN size USING (image) WHERE y = y0 AND (x - x0) % greatest(1, (x1 - x0 + 1) // 64) = 0 UNION ALL SELECT image, r, g, b FROM sheet JOIN size USING (image) WHERE y = y1 AND (x - x0) % greatest(1, (x1 - x0 + 1) // 64) = 0
  UNION ALL SELECT image, r, g, b FROM sheet JOIN size USING (image) WHERE x = x0 AND (y - y0) % greatest(1, (y1 - y0 + 1) // 64) = 0 UNION ALL SELECT image, r, g, b FROM sheet JOIN size USING (image) WHERE x = x1 AND (y - y0) % greatest(1, (y1 - y0 + 1) // 64) = 0),
flat AS (SELECT image, unnest([r, g, b]) AS v FROM ring), dev AS (SELECT image, round(stddev_pop(v), 6) AS deviation FROM flat GROUP BY 1)
SELECT image, count(*) AS seen, any_value(deviation) AS deviation, round_even(avg(r), 0)::BIGINT AS r, round_even(avg(g), 0)::BIGINT AS g, round_even(avg(b), 0)::BIGINT AS b, CASE WHEN any_value(deviation) < {plates.BORDER_DEVIATION} THEN 'pass' ELSE 'warn' END AS status FROM ring JOIN dev USING (image) GROUP BY image"""
)
def border_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each sheet's border is of one colour."""
    return plates.border_ring(sheet_view(spark, sf_dir), "image")


_PLAIN_SHEET = _SHEET.split("tot AS")[0].rstrip().rstrip(",")


@family.query(
    f"""WITH RECURSIVE {_PLAIN_SHEET}, two AS (SELECT s.*, CASE WHEN o.pk % 3 = 0 THEN (s.r + 90) % 256 ELSE s.r END AS r2, CASE WHEN o.pk % 5 = 0 THEN s.b + 8 ELSE s.b END AS b2 FROM sheet s JOIN ln o ON o.o // {ROWS} = s.image AND o.o % {ROWS} = s.y AND o.x = s.x WHERE o.pk % 17 <> 0),
m AS (SELECT image, y, x, greatest(abs(r - r2), abs(b - b2)) > 8 AS moved, r + g + b > 600 AS light FROM two), g AS (SELECT image, y, x FROM m WHERE moved AND light),
reach AS (SELECT image, y, x, y AS y0, x AS x0 FROM g UNION SELECT r.image, g.y, g.x, r.y0, r.x0 FROM reach r JOIN g ON g.image = r.image AND abs(g.y - r.y) + abs(g.x - r.x) = 1),
gap AS (SELECT image, max(n) AS gap FROM (SELECT image, y0, x0, count(*) AS n FROM reach GROUP BY ALL) GROUP BY image)
SELECT image, round(100.0::DOUBLE * count(*) FILTER (moved) / count(*), 4) AS changed, round(100.0::DOUBLE * count(*) FILTER (NOT light) / count(*), 3) AS ink, 100.0::DOUBLE * count(*) FILTER (NOT light) / count(*) BETWEEN 1 AND 99 AS valid,
  round(100.0::DOUBLE * count(*) FILTER (light AND moved) / count(*), 4) AS lost, round(100.0::DOUBLE * count(*) FILTER (NOT light AND moved) / count(*), 4) AS gained, coalesce(any_value(gap), 0) AS gap FROM m LEFT JOIN gap USING (image) GROUP BY image"""
)
def sheet_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sheet against a second render of it, which lacks some pixels and has others changed."""
    view, ids = sheet_view(spark, sf_dir), load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"))
    x = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    ids = ids.select(F.floor(F.col("l_orderkey") / ROWS).alias("image"), (F.col("l_orderkey") % ROWS).alias("y"), x.cast("long").alias("x"), "pk")
    after = view.join(ids.where("pk % 17 <> 0"), ["image", "y", "x"])
    after = after.select("image", "y", "x", F.when(F.col("pk") % 3 == 0, (F.col("r") + 90) % 256).otherwise(F.col("r")).alias("r"), "g", F.when(F.col("pk") % 5 == 0, F.col("b") + 8).otherwise(F.col("b")).alias("b"))
    return plates.drift(view, after, "image")
