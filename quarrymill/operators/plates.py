"""From a rendered sheet to its printing plates: inks, boundary blends, screens, continuous tone.

Colours meet in cells of the colour cube: near ones to cluster, and strays with the segments
between two anchors that pass by.  No stage compares all colours with all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.colour import packed
from quarrymill.operators.greedy import BUCKET, first_leaders

#: An ink's least share of the sheet, the distances within which colours are one ink and a
#: blend of two, the share beyond which nothing is an edge, the number of inks beyond which blends are left alone.
AREA_PERCENT, MERGE, BLEND, EDGE_PERCENT, MOST_INKS = 0.05, 20.0, 24.0, 5.0, 500
#: Shades of an ink that make a ramp; area and number of the small colours that make diffuse tone.
RAMP_MEMBERS, TONE_AREA, TONE_COLOURS = 6, 3.0, 2000
WHITE = 0xFFFFFF
PAPER = -1


def shares(pixels: DataFrame, image: str) -> DataFrame:
    """``image, r, g, b, rgb, n, share``: each colour's share of its sheet in percent.  The counts are a
    written table, so that pixels are read once."""
    from quarrymill.scratch import written

    counts = written(pixels.groupBy(image, "r", "g", "b").agg(F.count(F.lit(1)).alias("n")), "shares")
    total = counts.groupBy(image).agg(F.sum("n").alias("total"))
    return counts.join(total.hint("merge"), image).select(image, "r", "g", "b", packed(F.col("r"), F.col("g"), F.col("b")).alias("rgb"), "n", (100.0 * F.col("n") / F.col("total")).alias("share"))


def near_colours(colours: DataFrame, image: str, tolerance: float) -> DataFrame:
    """``block, place, earlier``: colours within the tolerance of an earlier one of their image."""
    cell = [F.floor(F.col(c) / tolerance) for c in "rgb"]
    sides = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    at = colours.select(F.col(image).alias("block"), "place", "r", "g", "b", *(c.alias(f"c{i}") for i, c in enumerate(cell)))
    around = at.select("block", F.col("place").alias("earlier"), *(F.col(c).alias(f"o{c}") for c in "rgb"), "c0", "c1", F.explode(F.transform(sides, lambda k: F.col("c2") + k)).alias("c2"))
    around = around.withColumn("c1", F.explode(F.transform(sides, lambda k: F.col("c1") + k))).withColumn("c0", F.explode(F.transform(sides, lambda k: F.col("c0") + k)))
    gap = sum(((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in "rgb"), F.lit(0))
    return at.join(around.hint("merge"), ["block", "c0", "c1", "c2"]).where((F.col("earlier") < F.col("place")) & (gap <= tolerance * tolerance)).select("block", "place", "earlier")


def _led(batches: Iterator[pa.RecordBatch], tolerance: float) -> Iterator[pa.RecordBatch]:
    """``leader`` of each colour of images that follow one another, their colours in order of ``place``: the
    first colour that has none leads itself and all near ones that have none, and so on."""

    def led(rows: pa.Table) -> pa.RecordBatch:
        place = rows["place"].to_numpy()
        at = np.column_stack([rows[c].to_numpy() for c in "rgb"])
        leader = np.empty_like(place)
        starts = np.flatnonzero(place == 1)
        for lo, hi in zip(starts, [*starts[1:], place.size], strict=True):
            left = np.arange(lo, hi)
            while left.size:
                near = ((at[left] - at[left[0]]) ** 2).sum(axis=1) <= tolerance * tolerance
                near[0] = True
                leader[left[near]] = place[left[0]]
                left = left[~near]
        return rows.append_column("leader", pa.array(leader)).combine_chunks().to_batches()[0]

    rest = None  # an image may go on in the next batch, so the last one waits for it
    for batch in batches:
        new = pa.Table.from_batches([batch])
        rows = new if rest is None else pa.concat_tables([rest, new])
        cut = int(np.flatnonzero(rows["place"].to_numpy() == 1)[-1]) if rows.num_rows else 0
        if cut:
            yield led(rows.slice(0, cut))
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield led(rest)


def ink_clusters(colours: DataFrame, image: str, tolerance: float = MERGE, most: int = BUCKET) -> DataFrame:
    """``image, cluster, r, g, b, n, members``: heaviest first, each colour (``r, g, b, n``) joins the
    first cluster whose first colour is near enough.  Images of up to ``most`` colours are decided in one
    pass each, larger ones in rounds over the links of near colours, with the same result."""
    from quarrymill.scratch import written

    order = Window.partitionBy(image).orderBy(F.col("n").desc(), "r", "g", "b")
    placed = colours.select(F.col(image), "r", "g", "b", "n", F.row_number().over(order).cast("long").alias("place"), F.count(F.lit(1)).over(Window.partitionBy(image)).alias("inks"))
    placed = written(placed, "placed")
    schema = ", ".join(f"{c} {kind}" for c, kind in placed.dtypes) + ", leader long"
    few = placed.where(F.col("inks") <= most).repartition(image).sortWithinPartitions(image, "place")
    found = few.mapInArrow(lambda batches: _led(batches, tolerance), schema)
    many = placed.where(F.col("inks") > most)
    if not many.isEmpty():
        led = first_leaders(many.select(F.col(image).alias("block"), "place"), near_colours(many, image, tolerance)).withColumnRenamed("block", image)
        found = found.unionByName(many.join(led.hint("merge"), [image, "place"]).select(*found.columns))
    sums = found.groupBy(image, "leader").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("members"), *(F.max(F.when(F.col("place") == F.col("leader"), F.col(c))).alias(c) for c in "rgb"))
    number = F.row_number().over(Window.partitionBy(image).orderBy("leader")) - 1
    return sums.select(image, number.cast("long").alias("cluster"), "r", "g", "b", "n", "members")


def blend_segments(clusters: DataFrame, image: str, tolerance: float = BLEND, paper: bool = True) -> DataFrame:
    """``image, cluster, one, two, gap``: of each cluster the two anchors (clusters, and white paper) whose
    segment passes nearest, if within the tolerance and between its ends; the first two on a tie.

    A segment is walked in steps of ``wide``, and stands in the cell of each step; a colour within the
    tolerance of the segment is at most a cell away from one of them."""
    own = clusters.select(image, "cluster", *(F.col(c).cast("double").alias(c) for c in "rgb"))
    white = own.select(image).distinct().select(image, F.lit(PAPER).cast("long").alias("cluster"), *(F.lit(255.0).alias(c) for c in "rgb"))
    # paper comes after all clusters, as an anchor of no cluster
    anchors = (own.unionByName(white) if paper else own).withColumn("turn", F.when(F.col("cluster") == PAPER, 1 << 40).otherwise(F.col("cluster")))
    a = anchors.select(image, F.col("cluster").alias("ia"), F.col("turn").alias("ta"), *(F.col(c).alias(f"a{c}") for c in "rgb"))
    b = anchors.select(image, F.col("cluster").alias("ib"), F.col("turn").alias("tb"), *(F.col(c).alias(f"b{c}") for c in "rgb"))
    along = {c: F.col(f"b{c}") - F.col(f"a{c}") for c in "rgb"}
    long2 = along["r"] * along["r"] + along["g"] * along["g"] + along["b"] * along["b"]
    # what grows in an explode is larger than Spark takes it for, and would be broadcast: such joins are by sorting
    pairs = a.join(b.hint("merge"), image).where("ta < tb").withColumn("long2", long2).where(F.col("long2") > (2 * tolerance) ** 2)
    wide = 2.0 * tolerance
    steps = F.sequence(F.lit(0), F.ceil(F.sqrt("long2") / wide).cast("int"))
    point = lambda c, k: F.floor((F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * F.least(F.lit(1.0), k * wide / F.sqrt("long2"))) / wide)
    cells = F.array_distinct(F.transform(steps, lambda k: F.struct(point("r", k).alias("x"), point("g", k).alias("y"), point("b", k).alias("z"))))
    walked = pairs.withColumn("cell", F.explode(cells)).select(image, "ia", "ib", "ta", "tb", "long2", *(f"{s}{c}" for s in "ab" for c in "rgb"), "cell.*")
    beside = lambda c: F.array(*(F.floor(F.col(c) / wide) + k for k in (-1, 0, 1)))
    here = own.select(image, "cluster", "r", "g", "b", F.explode(beside("r")).alias("x")).withColumn("y", F.explode(beside("g"))).withColumn("z", F.explode(beside("b")))
    met = here.join(walked.hint("merge"), [image, "x", "y", "z"]).dropDuplicates([image, "cluster", "ia", "ib"])
    from_a = {c: F.col(c) - F.col(f"a{c}") for c in "rgb"}
    t = (from_a["r"] * along["r"] + from_a["g"] * along["g"] + from_a["b"] * along["b"]) / F.col("long2")
    met = met.withColumn("t", t).where("t > 0 AND t < 1")
    off = lambda c: F.col(c) - (F.col(f"a{c}") + F.col("t") * (F.col(f"b{c}") - F.col(f"a{c}")))
    gap = F.round(F.sqrt(off("r") * off("r") + off("g") * off("g") + off("b") * off("b")), 9)
    near = met.withColumn("gap", gap).where(F.col("gap") <= tolerance)
    best = near.groupBy(image, "cluster").agg(F.min(F.struct("gap", "ta", "tb", "ia", "ib")).alias("x"))
    return best.select(image, "cluster", F.col("x.ia").alias("one"), F.col("x.ib").alias("two"), "x.gap")


def absorb_blends(clusters: DataFrame, segments: DataFrame, solid: DataFrame, image: str) -> DataFrame:
    """``clusters`` (``cluster, share``) with ``share`` after absorption, ``absorbed`` and ``kept``.

    In order, a small cluster without interior that has absorbed none goes to the larger of the two
    inks it lies between (to the one ink beside paper).  An image has ``MOST_INKS`` clusters at most here, any other
    is left as it is; so the pass over one image is of bounded size.  Clusters of an image count
    from 0 without gaps.  ``solid`` has ``cluster, has_interior``."""
    rows = clusters.join(segments.hint("merge"), [image, "cluster"], "left").join(solid.hint("merge"), [image, "cluster"], "left")
    rows = rows.withColumn("inks", F.count(F.lit(1)).over(Window.partitionBy(image)))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        """Whole images, one after the other, each by its clusters."""
        share, absorbed, kept = rows["share"].tolist(), [0] * len(rows), [True] * len(rows)
        first = 0
        for k, (cluster, small, a, b, inside) in enumerate(zip(rows["cluster"], rows["share"] <= EDGE_PERCENT, rows["one"], rows["two"], rows["has_interior"], strict=True)):
            first = k if cluster == 0 else first
            if absorbed[k] or not small or pd.isna(a) or (not pd.isna(inside) and inside):
                continue
            a, b = int(a), int(b)
            owner = first + (b if a == PAPER else a if b == PAPER or share[first + a] >= share[first + b] else b)
            share[owner] += share[k]
            absorbed[owner] += 1
            kept[k] = False
        return rows.assign(share=share, absorbed=absorbed, kept=kept)[columns]

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """An image may go on in the next batch, so the last one of a batch waits for it."""
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            starts = rows.index[rows["cluster"] == 0]
            cut = starts[-1] if len(starts) else 0
            if cut:
                yield fold(rows[:cut].reset_index(drop=True))
            rest = rows[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield fold(rest)

    columns = [*clusters.columns, "absorbed", "kept"]
    schema = ", ".join(f"{n} {t}" for n, t in clusters.dtypes) + ", absorbed long, kept boolean"
    few = rows.where(F.col("inks") <= MOST_INKS).repartition(image).sortWithinPartitions(image, "cluster").mapInPandas(folded, schema)
    many = rows.where(F.col("inks") > MOST_INKS).select(*clusters.columns, F.lit(0).cast("long").alias("absorbed"), F.lit(True).alias("kept"))
    return few.unionByName(many)


def plates(pixels: DataFrame, image: str, area: float = AREA_PERCENT, merge: float = MERGE, blend: float = BLEND, colours: DataFrame | None = None) -> DataFrame:
    """``image, cluster, r, g, b, share, members, absorbed, kept`` of the sheet's inks on white paper.
    ``colours`` are the pixels' ``shares``, where they are known."""
    from quarrymill.operators.pixels import interior
    from quarrymill.scratch import written

    colours = shares(pixels, image) if colours is None else colours
    large = colours.where((F.col("share") >= area) & (F.col("rgb") != WHITE))
    inks = ink_clusters(large, image, merge)
    total = colours.groupBy(image).agg(F.sum("n").alias("total"))
    inks = written(inks.join(total.hint("merge"), image).withColumn("share", 100.0 * F.col("n") / F.col("total")).drop("n", "total"), "inks")
    solid = interior(pixels.withColumn("rgb", packed(F.col("r"), F.col("g"), F.col("b"))), "rgb", image)
    solid = inks.select(image, "cluster", packed(F.col("r"), F.col("g"), F.col("b")).alias("rgb")).join(solid.hint("merge"), [image, "rgb"]).select(image, "cluster", "has_interior")
    return absorb_blends(inks, blend_segments(inks, image, blend), solid, image)


def tone(pixels: DataFrame, inks: DataFrame, image: str, area: float = AREA_PERCENT, members: int = RAMP_MEMBERS, tone_area: float = TONE_AREA, tone_colours: int = TONE_COLOURS, colours: DataFrame | None = None) -> DataFrame:
    """CONTINUOUS_TONE and the screens of each image: ``image, screens, ramps, ramp_members, diffuse_area,
    diffuse_colours, arm``.  ``arm`` is ramp where one ink is made of many near shades, diffuse where
    colours too small for an ink cover much of the sheet together, else null."""
    colours = shares(pixels, image) if colours is None else colours
    small = colours.groupBy(image).agg(F.coalesce(F.sum(F.when((F.col("share") < area) & (F.col("rgb") != WHITE), F.col("share"))), F.lit(0.0)).alias("diffuse_area"), F.count_if((F.col("share") < area) & (F.col("rgb") != WHITE)).alias("diffuse_colours"))
    ramp = F.col("members") >= members
    own = inks.where(F.col("kept") & (F.col("share") >= area)).groupBy(image).agg(F.count(F.lit(1)).alias("screens"), F.count_if(ramp).alias("ramps"), F.max_by("members", F.when(ramp, F.struct("share", -F.col("cluster")))).alias("ramp_members"))
    found = small.join(own.hint("merge"), image, "left").fillna(0, ["screens", "ramps"])
    diffuse = (F.col("diffuse_area") >= tone_area) & (F.col("diffuse_colours") >= tone_colours)
    return found.withColumn("arm", F.when(F.col("ramps") > 0, "ramp").when(diffuse, "diffuse"))


def too_many_screens(tones: DataFrame, most: int) -> Column:
    """COLOR_COUNT_RENDERED: whether a sheet needs more screens than allowed."""
    return tones["screens"] > most


#: Fixed value: the deviation below which a sheet's border is one colour.
BORDER_DEVIATION = 16.0


def border_ring(pixels: DataFrame, image: str, steps: int = 64) -> DataFrame:
    """``image, seen, deviation, r, g, b, status`` of the pixels along each sheet's border, some
    ``steps`` of them a side; corners count for both of theirs."""
    size = pixels.groupBy(image).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = pixels.join(size, image)
    every = lambda v, lo, hi: (F.col(v) - F.col(lo)) % F.greatest(F.lit(1), F.floor((F.col(hi) - F.col(lo) + 1) / steps)) == 0
    along, down = every("x", "x0", "x1"), every("y", "y0", "y1")
    sides = sum(((on & by).cast("int") for on, by in ((F.col("y") == F.col("y0"), along), (F.col("y") == F.col("y1"), along), (F.col("x") == F.col("x0"), down), (F.col("x") == F.col("x1"), down))), F.lit(0))
    ring = at.withColumn("sides", sides).where("sides > 0")
    total = sum((F.col(c) for c in "rgb"), F.lit(0))
    squares = sum((F.col(c) * F.col(c) for c in "rgb"), F.lit(0))
    sums = ring.groupBy(image).agg(F.sum("sides").alias("seen"), F.sum(F.col("sides") * total).alias("s"), F.sum(F.col("sides") * squares).alias("q"), *(F.bround(F.sum(F.col("sides") * F.col(c)) / F.sum("sides")).cast("long").alias(c) for c in "rgb"))
    n = 3 * F.col("seen")
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / n - (F.col("s") / n) * (F.col("s") / n)))
    return sums.select(image, "seen", F.round(deviation, 6).alias("deviation"), "r", "g", "b").withColumn("status", F.when(F.col("deviation") < BORDER_DEVIATION, "pass").otherwise("warn"))


#: The channel difference of a changed pixel, the brightness of paper, the shares of ink between which its drift says something.
CHANGED, LIGHT, INK_LEAST, INK_MOST = 8, 600, 1.0, 99.0


def drift(before: DataFrame, after: DataFrame, image: str) -> DataFrame:
    """What a change did to each sheet, over the pixels that both renders have: ``image, changed, ink, valid,
    lost, gained, gap``, in percent; ``lost`` is changed paper, ``gained`` changed ink, ``gap`` the largest
    blob of changed paper (0: none).  On sheets of hardly any ink, or paper, ``valid`` is false."""
    from quarrymill.operators.pixels import blob_sizes
    from quarrymill.scratch import written

    both = before.join(after.select(image, "y", "x", *(F.col(c).alias(f"_{c}") for c in "rgb")), [image, "y", "x"])
    moved = F.greatest(*(F.abs(F.col(c) - F.col(f"_{c}")) for c in "rgb")) > CHANGED
    marked = written(both.select(image, "y", "x", moved.alias("moved"), (F.col("r") + F.col("g") + F.col("b") > LIGHT).alias("light")), "drift")
    share = lambda what: F.round(100.0 * F.count_if(what) / F.count(F.lit(1)), 4)
    sums = marked.groupBy(image).agg(share(F.col("moved")).alias("changed"), (100.0 * F.count_if(~F.col("light")) / F.count(F.lit(1))).alias("ink"), share(F.col("light") & F.col("moved")).alias("lost"), share(~F.col("light") & F.col("moved")).alias("gained"))
    gaps = blob_sizes(marked.where("light AND moved"), image).select(image, F.col("largest").alias("gap"))
    found = sums.join(gaps, image, "left").withColumn("valid", F.col("ink").between(INK_LEAST, INK_MOST))
    return found.select(image, "changed", F.round("ink", 3).alias("ink"), "valid", "lost", "gained", F.coalesce("gap", F.lit(0)).cast("long").alias("gap"))
