"""Rules over a table of markup elements (``schemas.ELEMENTS``): each gives its findings as rows.

Names and bounds of element kinds are fixed values of the markup language.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import numeric
from quarrymill.operators import scopes
from quarrymill.operators.cascade import style_rules
from quarrymill.operators.scopes import GRADIENTS, SHAPES

PAINTS = ("fill", "stroke", "stop-color", "flood-color", "lighting-color")
EFFECTS = ("filter", "mask", "clip-path")
DATA_IMAGE = r"(?i)url\(\s*['\"]?data:image/"
REFERENCE = r"(?i)url\(\s*['\"]?#([^'\")\s]+)"
TINY = 1e-9


def declared_once(elements: DataFrame) -> DataFrame:
    """``elements`` with the declarations of ``style`` read once, for ``attr``."""
    return elements.withColumn("_declared", numeric.declarations(F.coalesce(plain("style"), F.lit(""))))


def attr(name: str) -> Column:
    """An attribute, or the declaration of that name in ``style``, which goes before it."""
    return F.coalesce(F.try_element_at("_declared", F.lit(name)), plain(name))


def plain(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _kind() -> Column:
    return F.lower("tag")


def _external(href: Column) -> Column:
    bare = F.trim(F.coalesce(href, F.lit("")))
    return (bare != "") & ~bare.startswith("#")


def sheet_text(elements: DataFrame) -> Column:
    """The text of style elements, where the table carries it."""
    return F.coalesce("text", F.lit("")) if "text" in elements.columns else F.lit("")


def raster_sources(elements: DataFrame) -> DataFrame:
    """RASTER_EMBED: ``doc_id, node_id, kind`` of whatever brings a bitmap along."""
    kind, href = _kind(), plain("href")
    own = F.when(kind == "image", "image").when((kind == "feimage") & _external(href), "feImage").when(kind == "foreignobject", "foreignObject").when((kind == "use") & _external(href), "use")
    text = F.when(kind == "style", sheet_text(elements)).otherwise(F.coalesce(plain("style"), F.lit("")))
    style = F.array_repeat(F.lit("style url()"), F.regexp_count(text, F.lit(DATA_IMAGE)))
    return elements.select("doc_id", "node_id", F.explode(F.concat(F.array_compact(F.array(own)), style)).alias("kind"))


def colours_in_force(elements: DataFrame, combinators: str = " ") -> DataFrame:
    """``doc_id, colour, n``: colours that inking elements paint with, by the cascade and by what is
    inherited; a fill that nobody declares is black; gradients count by their stops."""
    return scopes.inks(scopes.resolved(elements, combinators, **scopes.INKS)).groupBy("doc_id", "colour").agg(F.count(F.lit(1)).alias("n"))


def colour_count(elements: DataFrame, most: int) -> DataFrame:
    """COLOR_COUNT: documents with more colours than allowed."""
    return colours_in_force(elements).groupBy("doc_id").agg(F.count(F.lit(1)).alias("colours")).where(F.col("colours") > most)


def off_palette(elements: DataFrame, palette: list[str]) -> DataFrame:
    """PALETTE: colours in force that are on no list (an empty list allows all)."""
    found = colours_in_force(elements)
    return found.where(~F.col("colour").isin([p.lower() for p in palette])) if palette else found.limit(0)


def gradients(elements: DataFrame) -> DataFrame:
    """GRADIENT_NOT_ALLOWED: ``doc_id, node_id, kind, target`` of gradients and paints by reference."""
    refs = [F.when(attr(p).rlike(REFERENCE), F.struct(F.lit(p).alias("kind"), F.regexp_extract(attr(p), REFERENCE, 1).alias("target"))) for p in PAINTS]
    own = F.when(_kind().isin(*GRADIENTS), F.struct(F.lit("definition").alias("kind"), F.coalesce(plain("id"), F.lit("")).alias("target")))
    found = declared_once(elements).select("doc_id", "node_id", F.explode(F.array_compact(F.array(own, *refs))).alias("x")).select("doc_id", "node_id", "x.*")
    if "text" in elements.columns:
        # a sheet's paints by reference, each block once however many selectors it has
        rules = style_rules(elements.where(_kind() == "style")).where(F.col("prop").isin(*PAINTS) & F.col("value").rlike(REFERENCE))
        rules = rules.dropDuplicates(["doc_id", "rule", "prop"]).where("rule.turn = 0")
        found = found.unionByName(rules.select("doc_id", F.col("rule.sheet").alias("node_id"), F.col("prop").alias("kind"), F.regexp_extract("value", REFERENCE, 1).alias("target")))
    return found


def id_references(elements: DataFrame) -> DataFrame:
    """``doc_id, node_id, prop, target, kind``: what each reference names; kind null where
    nothing in the document has the id."""
    found = [F.when(attr(p).rlike(REFERENCE), F.struct(F.lit(p).alias("prop"), F.regexp_extract(attr(p), REFERENCE, 1).alias("target"))) for p in (*PAINTS, *EFFECTS)]
    link = F.when(F.trim(plain("href")).startswith("#"), F.struct(F.lit("href").alias("prop"), F.substring(F.trim(plain("href")), 2, 1000).alias("target")))
    refs = declared_once(elements).select("doc_id", "node_id", F.explode(F.array_compact(F.array(link, *found))).alias("x")).select("doc_id", "node_id", "x.*")
    named = elements.where(plain("id").isNotNull()).groupBy("doc_id", plain("id").alias("target")).agg(F.min_by("tag", "node_id").alias("kind"))
    return refs.join(named, ["doc_id", "target"], "left")


def paint_scopes(elements: DataFrame) -> DataFrame:
    """``doc_id, node_id, scope`` of every element (see ``scopes.resolved``)."""
    return scopes.resolved(elements, **scopes.SCOPES).select("doc_id", "node_id", "scope")


def thin_strokes(elements: DataFrame, least: float, mm_per_unit: float = 25.4 / 96) -> DataFrame:
    """MIN_STROKE_WIDTH: ``doc_id, node_id, width, points`` of shapes whose stroke inks below the
    least width in points; points null where the width cannot be read."""
    found = scopes.strokes(scopes.resolved(elements, **scopes.STROKES))
    return found.withColumn("points", numeric.length_points(F.col("width"), mm_per_unit)).where(F.col("points").isNull() | (F.col("points") < least))


def dimensions(elements: DataFrame, width_mm: float | None, height_mm: float | None, tolerance: float = 0.5, mm_per_unit: float = 25.4 / 96) -> DataFrame:
    """DIMENSIONS: ``doc_id, axis, actual_mm`` of roots out of tolerance; without a usable
    width or height the view box serves, and without that nothing is said."""
    box = F.split(F.trim(F.coalesce(plain("viewBox"), F.lit(""))), r"[\s,]+")
    side = lambda i: F.when((F.size(box) == 4) & (F.get(box, 2).try_cast("double") > 0) & (F.get(box, 3).try_cast("double") > 0), F.get(box, i).try_cast("double") * mm_per_unit)
    size = lambda name, i: F.coalesce(numeric.length_points(plain(name), mm_per_unit) * 25.4 / 72, side(i))
    roots = elements.where("parent_id IS NULL").select("doc_id", size("width", 2).alias("w"), size("height", 3).alias("h")).where("w IS NOT NULL AND h IS NOT NULL")
    ordered = [F.struct(F.lit(n).alias("axis"), F.col(c).alias("actual_mm"), F.lit(float(x)).alias("ordered_mm")) for n, c, x in (("width", "w", width_mm), ("height", "h", height_mm)) if x is not None]
    if not ordered:
        return roots.select("doc_id", F.lit("").alias("axis"), F.col("w").alias("actual_mm")).limit(0)
    return roots.select("doc_id", F.explode(F.array(*ordered)).alias("x")).where(F.abs(F.col("x.actual_mm") - F.col("x.ordered_mm")) > tolerance).select("doc_id", "x.axis", "x.actual_mm")


def notes(elements: DataFrame) -> DataFrame:
    """``doc_id, node_id, rule`` of what is reported without failing (see ``scopes.notes``)."""
    return scopes.notes(scopes.resolved(elements))


_TOKEN = re.compile(r"([A-Za-z])|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|([\s,]+)")
_TAKES = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}


def path_segments(data: str) -> list[list[list[tuple[float, float]]]]:
    """Subpaths of path data, each a list of segments, each a list of points (ends and
    controls; an arc by its ends).  A close adds a line where the ends are apart."""
    tokens, at = [], 0
    for m in _TOKEN.finditer(data):
        if m.start() != at:
            raise ValueError(f"no path data at {at}")
        at = m.end()
        if m[1]:
            if m[1].upper() not in _TAKES:
                raise ValueError(f"no command {m[1]}")
            tokens.append(m[1])
        elif m[2]:
            tokens.append(float(m[2]))
    if at != len(data):
        raise ValueError(f"no path data at {at}")
    out: list[list] = []
    here = start = (0.0, 0.0)
    command, i = "", 0
    while i < len(tokens):
        if isinstance(tokens[i], str):
            command, i = tokens[i], i + 1
        elif not command or command in "Zz":
            raise ValueError("a number without a command")
        upper, relative = command.upper(), command.islower()
        n = _TAKES[upper]
        args = tokens[i : i + n]
        if len(args) < n or any(isinstance(a, str) for a in args):
            raise ValueError(f"too few numbers for {command}")
        i += n
        base = here if relative else (0.0, 0.0)
        if upper == "Z":
            if out and here != start:
                out[-1].append([here, start])
            here = start
            continue
        if upper == "M":
            here = start = (base[0] + args[0], base[1] + args[1])
            out.append([])
            command = "l" if relative else "L"
            continue
        if not out:
            raise ValueError("no point to begin from")
        if upper == "H":
            points = [(base[0] + args[0], here[1])]
        elif upper == "V":
            points = [(here[0], base[1] + args[0])]
        else:
            pairs = args[-2:] if upper == "A" else args
            points = [(base[0] + x, base[1] + y) for x, y in zip(pairs[::2], pairs[1::2], strict=True)]
        if not out[-1] and here != start:
            start = here
        out[-1].append([here, *points])
        here = points[-1]
    return out


def path_measures(data: str | None) -> tuple[str, int, int, int, int, int]:
    """``state, nodes, subpaths, open_subpaths, closes, moves`` of path data; the state is
    empty, unparseable, zero_length, zero_area or drawn."""
    text = data or ""
    closes, moves = text.upper().count("Z"), text.upper().count("M")
    if not text.strip():
        return "empty", 0, 0, 0, closes, moves
    try:
        subpaths = path_segments(text)
    except ValueError:
        return "unparseable", 0, 0, 0, closes, moves
    nodes = sum(map(len, subpaths))
    if not nodes:
        return "empty", 0, 0, 0, closes, moves
    length = lambda sub: sum(math.dist(a, b) for seg in sub for a, b in zip(seg, seg[1:], strict=False))
    drawn = [sub for sub in subpaths if sub and length(sub) > TINY]
    open_ones = sum(math.dist(sub[0][0], sub[-1][-1]) > TINY for sub in drawn)
    if not drawn:
        return "zero_length", nodes, len(subpaths), 0, closes, moves
    # the area of the control polygon is nought wherever that of a collapsed shape is
    area = sum(abs(sum(a[0] * b[1] - b[0] * a[1] for seg in sub for a, b in zip(seg, seg[1:], strict=False))) / 2 for sub in drawn)
    state = "zero_area" if not open_ones and area <= TINY else "drawn"
    return state, nodes, len(subpaths), open_ones, closes, moves


def path_table(elements: DataFrame) -> DataFrame:
    """``doc_id, node_id, state, nodes, subpaths, open_subpaths, closes, moves`` of every path."""
    paths = elements.where(_kind() == "path").select("doc_id", "node_id", plain("d").alias("d"))
    names = ["state", "nodes", "subpaths", "open_subpaths", "closes", "moves"]

    def run(batches):
        for pdf in batches:
            measured = pd.DataFrame([path_measures(d) for d in pdf["d"]], columns=names)
            yield pd.concat([pdf[["doc_id", "node_id"]].reset_index(drop=True), measured], axis=1)

    kind = dict(elements.dtypes)["doc_id"]
    return paths.mapInPandas(run, f"doc_id {kind}, node_id long, state string, nodes long, subpaths long, open_subpaths long, closes long, moves long")


def path_findings(paths: DataFrame, allow_open: bool = False) -> DataFrame:
    """PATH_PARSE_ERROR, ZERO_AREA_PATH and OPEN_PATH of a path table."""
    rule = F.when(F.col("state") == "unparseable", "PATH_PARSE_ERROR").when(F.col("state") != "drawn", "ZERO_AREA_PATH").when((F.col("open_subpaths") > 0) & ~F.lit(allow_open), "OPEN_PATH")
    return paths.select("doc_id", "node_id", rule.alias("rule")).where("rule IS NOT NULL")


def path_totals(paths: DataFrame, limit: int) -> DataFrame:
    """Paths, nodes, most nodes, paths over the limit, and the closing and moving commands."""
    return paths.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("paths"), F.sum("nodes").alias("nodes_total"), F.max("nodes").alias("nodes_max"),
        F.count_if(F.col("nodes") > limit).alias("over_limit"), F.sum("closes").alias("closes"), F.sum("moves").alias("moves"),
    )


def closure_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``doc_id, closes, closes_after, moves, moves_after`` of drawings whose closing or moving commands are
    not as many as before: what a count of nodes cannot see.  Both are totals of paths; a drawing that one
    side lacks counts as none."""
    other = after.select("doc_id", F.col("closes").alias("closes_after"), F.col("moves").alias("moves_after"))
    both = before.select("doc_id", "closes", "moves").join(other, "doc_id", "full").fillna(0, ["closes", "moves", "closes_after", "moves_after"])
    return both.where("closes <> closes_after OR moves <> moves_after").select("doc_id", "closes", "closes_after", "moves", "moves_after")
