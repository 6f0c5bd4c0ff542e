"""Pixel analytics over tables of pixels and histograms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.colour import packed


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(packed(F.col("r"), F.col("g"), F.col("b")).alias("rgb")).agg(F.count(F.lit(1)).alias("n"))


def coarse_histogram(pixels: DataFrame) -> DataFrame:
    """Six bits a channel; each cell keeps its most frequent colour."""
    exact = pixels.groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    cell = [F.shiftright(c, 2).alias(f"c{c}") for c in "rgb"]
    return exact.groupBy(*cell).agg(F.max_by(packed(F.col("r"), F.col("g"), F.col("b")), F.struct("n", -packed(F.col("r"), F.col("g"), F.col("b")))).alias("rgb"), F.sum("n").alias("n"))


def nearest_palette(r: Column, g: Column, b: Column, palette: Sequence[tuple[int, int, int]]) -> Column:
    """Index of the nearest palette entry, the first on a tie: an expression, no join."""
    d = [(r - p[0]) * (r - p[0]) + (g - p[1]) * (g - p[1]) + (b - p[2]) * (b - p[2]) for p in palette]
    return F.array_min(F.array(*(F.struct(x.cast("long").alias("d"), F.lit(i).alias("i")) for i, x in enumerate(d))))["i"]


def band_join(histogram: DataFrame, colours: DataFrame, tolerance: int = 16) -> DataFrame:
    """Histogram rows within the tolerance of a colour in every channel.

    Red is cut into cells of the tolerance's width; a row meets three neighbouring cells,
    so it is an equi-join with a filter, not all pairs."""
    width = tolerance + 1
    cells = colours.withColumn("cell", F.explode(F.array(*(F.floor(F.col("cr") / width) + k for k in (-1, 0, 1)))))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tolerance
    return histogram.withColumn("cell", F.floor(F.col("r") / width)).join(cells, "cell").where(near("r", "cr") & near("g", "cg") & near("b", "cb")).drop("cell")


def leader_clusters(histogram: DataFrame, image: str, tolerance: float = 20.0) -> DataFrame:
    """Greedy clusters of an image's colours: heaviest first, each joins the first cluster
    whose representative is near enough (see ``plates.ink_clusters``)."""
    from quarrymill.operators.plates import ink_clusters

    return ink_clusters(histogram, image, tolerance).select(image, "cluster", "r", "g", "b", "n", "members")


def _neighbours(value: str, image: str) -> dict[str, Column]:
    """The four neighbours on a grid; null where there is none."""
    row, column = Window.partitionBy(image, "y").orderBy("x"), Window.partitionBy(image, "x").orderBy("y")
    out = {}
    for name, axis, w, step in (("left", "x", row, 1), ("right", "x", row, -1), ("up", "y", column, 1), ("down", "y", column, -1)):
        there = F.lag(axis, step).over(w) == F.col(axis) - step
        out[name] = F.when(there, F.lag(value, step).over(w))
    return out


def laplacian_energy(pixels: DataFrame, value: str, image: str) -> DataFrame:
    """Mean absolute Laplacian over pixels that have all four neighbours."""
    seen = pixels.withColumns({f"_{k}": v for k, v in _neighbours(value, image).items()})
    total = F.abs(F.col("_left") + F.col("_right") + F.col("_up") + F.col("_down") - 4 * F.col(value))
    return seen.groupBy(image).agg(F.round(F.avg(total), 6).alias("energy"), F.count(total).alias("pixels"))


def interior(pixels: DataFrame, value: str, image: str) -> DataFrame:
    """Whether any pixel of a value has only its like on all four sides."""
    seen = pixels.withColumns({f"_{k}": v for k, v in _neighbours(value, image).items()})
    inside = F.lit(True)
    for k in ("left", "right", "up", "down"):
        inside = inside & F.coalesce(F.col(f"_{k}") == F.col(value), F.lit(False))
    return seen.groupBy(image, value).agg(F.bool_or(inside).alias("has_interior"), F.count(F.lit(1)).alias("pixels"))


def fidelity(channels: DataFrame, key: str) -> DataFrame:
    """Mean error and 95th percentile over channels, share of pixels within 10, and mean
    error over the artwork.  ``channels`` has ``key, deltas array, artwork boolean``; the
    percentile is read from counts of the values, of which a channel has 256."""
    pixel = channels.groupBy(key).agg(F.round(F.avg((F.array_max("deltas") < 10).cast("double")), 6).alias("within10"))
    counts = channels.select(key, "artwork", F.explode("deltas").alias("d")).groupBy(key, "d").agg(F.count(F.lit(1)).alias("n"), F.count_if("artwork").alias("art"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy("d"))
    placed = counts.withColumns({"upto": upto, "all": F.sum("n").over(Window.partitionBy(key))}).withColumn("place", 0.95 * (F.col("all") - 1))
    at = lambda edge: F.min(F.when(F.col("upto") > edge, F.col("d")))
    low, high = at(F.floor("place")), at(F.ceil("place"))
    part = F.max(F.col("place") - F.floor("place"))
    art = F.when(F.sum("art") > 0, F.sum(F.col("d") * F.col("art")) / F.sum("art"))
    return (
        placed.groupBy(key)
        .agg(F.round(F.sum(F.col("d") * F.col("n")) / F.sum("n"), 6).alias("mae"), F.round(low + (high - low) * part, 6).alias("p95"), F.round(art, 6).alias("mae_art"))
        .join(pixel, key)
    )


def runs(pixels: DataFrame, image: str) -> DataFrame:
    """``image, y, lo, hi``: each row's runs of neighbouring pixels."""
    return _runs(pixels.select(image, "y", "x"), image, [])


def _runs(pixels: DataFrame, image: str, tile: list[str]) -> DataFrame:
    row = Window.partitionBy(image, *tile, "y").orderBy("x")
    island = F.col("x") - F.row_number().over(row)
    return pixels.distinct().withColumn("_island", island).groupBy(image, *tile, "y", "_island").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).drop("_island")


def _joined_runs(batches: Iterator[pa.RecordBatch], image: str) -> Iterator[pa.RecordBatch]:
    """``hy, hlo`` of each run: the first run of its tile that it hangs together with in the tile.  Tiles
    follow one another, their runs in order of row and column; a tile waits for its end."""
    names = (image, "ty", "tx", "y", "lo", "hi")
    tile, rows, out = None, [], []

    def solve() -> None:
        head, at = list(range(len(rows))), 0  # of each run the first one of its tree; ``at`` runs through the row above

        def root(k: int) -> int:
            while head[k] != k:
                head[k] = k = head[head[k]]
            return k

        for k, (_, _, _, y, lo, hi) in enumerate(rows):
            while at < k and (rows[at][3] < y - 1 or (rows[at][3] == y - 1 and rows[at][5] < lo)):
                at += 1
            above = at
            while above < k and rows[above][3] == y - 1 and rows[above][4] <= hi:
                a, b = root(above), root(k)
                head[max(a, b)] = min(a, b)
                above += 1
        for k, row in enumerate(rows):
            first = rows[root(k)]
            out.append((*row, first[3], first[4]))

    def batch_of(template: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [template.schema.field(n).type for n in names]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), [*kinds, kinds[3], kinds[4]], strict=True)], [*names, "hy", "hlo"])

    batch = None
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if row[:3] != tile or None in row:  # nothing hangs together where image or place is not known
                solve()
                tile, rows = row[:3], []
            rows.append(row)
        if out:
            yield batch_of(batch)
            out.clear()
    solve()
    if out:
        yield batch_of(batch)


def blobs(pixels: DataFrame, image: str, block: int = 256) -> DataFrame:
    """``image, blob, pixels`` of the 4-connected blobs of marked pixels.

    A raster is cut into tiles of ``block`` rows and columns.  What hangs together inside a tile is found
    there in one pass over its runs; only these parts are nodes, linked where runs meet across the edge of
    a tile, and blobs are their components.  So a raster of any size is many tasks, and rounds are for
    what crosses tiles."""
    from quarrymill.operators.relations import components
    from quarrymill.scratch import written

    tiled = pixels.select(image, F.floor(F.col("y") / block).alias("ty"), F.floor(F.col("x") / block).alias("tx"), "y", "x")
    cut = _runs(tiled, image, ["ty", "tx"]).select(image, "ty", "tx", "y", "lo", "hi")
    kinds = dict(cut.dtypes)
    schema = ", ".join(f"{c} {kind}" for c, kind in cut.dtypes) + f", hy {kinds['y']}, hlo {kinds['lo']}"
    dealt = cut.repartition(image, "ty", "tx").sortWithinPartitions(image, "ty", "tx", "y", "lo")
    node = F.struct(F.col(image).cast("string").alias("image"), F.col("hy").alias("y"), F.col("hlo").alias("lo"))
    found = written(dealt.mapInArrow(lambda batches: _joined_runs(batches, image), schema).withColumn("node", node), "runs")
    # a tile's last row meets the next one's first, its last column the next one's first
    below = found.where(F.col("y") == F.col("ty") * block).select(image, "tx", (F.col("y") - 1).alias("y"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("node").alias("b"))
    down = found.where(F.col("y") + 1 == (F.col("ty") + 1) * block).join(below, [image, "tx", "y"]).where("lo <= hi2 AND lo2 <= hi").select(F.col("node").alias("a"), "b")
    beside = found.where(F.col("lo") == F.col("tx") * block).select(image, "y", (F.col("lo") - 1).alias("hi"), F.col("node").alias("b"))
    across = found.where(F.col("hi") + 1 == (F.col("tx") + 1) * block).join(beside, [image, "y", "hi"]).select(F.col("node").alias("a"), "b")
    links = written(down.unionByName(across).distinct(), "links")
    parts = found.groupBy(image, "node").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("pixels"))
    if links.isEmpty():
        return parts.select(image, F.col("node").alias("blob"), "pixels")
    labels = components(links).withColumnRenamed("component", "_blob")
    sized = parts.join(labels, "node", "left").withColumn("_blob", F.coalesce("_blob", "node"))
    return sized.groupBy(image, F.col("_blob").alias("blob")).agg(F.sum("pixels").alias("pixels"))


def blob_sizes(pixels: DataFrame, image: str) -> DataFrame:
    """Largest 4-connected blob of each image's marked pixels, and how many there are."""
    return blobs(pixels, image).groupBy(image).agg(F.max("pixels").alias("largest"), F.count(F.lit(1)).alias("blobs"))
