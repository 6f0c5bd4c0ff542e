"""What an element paints with and whether its ink reaches the sheet, resolved for a whole drawing.

Each element is a function from its parent's scope to its own: hidden and inert swallow whatever
stands below, a reference, a gradient and a definition set the scope, anything else hands it on.
Such functions compose, and so do inherited properties, so one climb by pointer doubling resolves
all of them together, in as many rounds as the depth has binary digits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import colour
from quarrymill.operators import whole
from quarrymill.operators.cascade import INITIAL, PROPERTIES, cascaded, handed_down, own_value
from quarrymill.operators.relations import climb
from quarrymill.scratch import collected, drop, once, written

#: Elements that ink; content that never inks; gradients; content that inks where referred to.
SHAPES = ("path", "rect", "circle", "ellipse", "line", "polyline", "polygon", "text", "tspan", "textpath", "use")
INERT = ("clippath", "filter", "style", "metadata", "title", "desc", "script", "view", "cursor")
GRADIENTS = ("lineargradient", "radialgradient")
DEFERRED = ("defs", "symbol", "pattern", "mask", "marker")
LINK = r"(?i)url\(\s*['\"]?\s*#([^'\")]+?)\s*['\"]?\s*\)"
_PASSED = {"fill": "fill", "stroke": "stroke", "stroke_width": "stroke-width", "fill_opacity": "fill-opacity", "stroke_opacity": "stroke-opacity", "color": "color"}

#: What inks, strokes and scopes read of a resolved drawing (``resolved(..., **INKS)``).
INKS = {"passed": ("fill", "stroke", "fill_opacity", "stroke_opacity", "color"), "own": ("stop-color",)}
STROKES = {"passed": ("stroke", "stroke_width", "stroke_opacity")}
SCOPES = {"passed": ()}
NOTES = {"passed": ("stroke", "fill_opacity", "stroke_opacity"), "own": ("filter", "mask", "clip-path", "opacity")}
#: The scopes that inks, strokes and notes are found in (``drawn(..., kept=INKED, **INKS)``).
INKED, STROKED, NOTED = ("painted", "resource"), ("painted",), ("painted", "resource", "unchecked")
#: Elements of a document that one task settles in one pass.
WHOLE = 65536


def fraction(raw: Column) -> Column:
    """A number or percentage as a number; anything else says nothing."""
    text = F.trim(raw)
    return F.when(text.endswith("%"), F.regexp_replace(text, "%$", "").try_cast("double") / 100.0).otherwise(text.try_cast("double"))


def visible(raw: Column) -> Column:
    """An opacity that is not known to be nought."""
    return F.coalesce(fraction(raw) > 0, F.lit(True))


def _linking(v: Column) -> Column:
    return v.contains("#") & v.contains("(")


def _used(href: Column) -> Column:
    """The id that a use's ``href`` names."""
    href = F.trim(href)
    return F.when((F.lower("tag") == "use") & href.startswith("#") & (F.length(href) > 1), F.substr(href, F.lit(2)))


def referred_ids(elements: DataFrame) -> DataFrame:
    """``doc_id, id`` of everything that an attribute's ``url(#id)`` or a use's ``href`` names."""
    named = F.filter(F.map_values("attrs"), _linking)
    links = F.flatten(F.transform(named, lambda v: F.regexp_extract_all(v, F.lit(LINK), F.lit(1))))
    used = _used(F.try_element_at("attrs", F.lit("href")))
    return elements.select("doc_id", F.explode(F.array_compact(F.concat(links, F.array(used)))).alias("id")).distinct()


def _links(attrs: dict[str, Column] | None) -> Column:
    """An element's attributes as one text where any of them links; no link reaches over two quotes."""
    if attrs is None:
        return F.when(F.exists(F.map_values("attrs"), lambda v: F.coalesce(_linking(v), F.lit(False))), F.array_join(F.map_values("attrs"), "''"))
    return F.when(reduce(Column.__or__, map(_linking, attrs.values())), F.concat_ws("''", *attrs.values()))


def resolved(elements: DataFrame, combinators: str = " ", passed: Sequence[str] | None = None, own: Sequence[str] = ()) -> DataFrame:
    """``elements`` with the inherited properties in force (``fill, stroke, stroke_width,
    fill_opacity, stroke_opacity, color``; null: nobody declares it), ``scaled`` (a scaling transform
    on it or above), ``visibility``, ``container`` (the scope below the element) and ``scope``: painted, resource (a gradient), unchecked
    (a definition that nothing refers to), inert or hidden.

    Where ``passed`` names the inherited properties that are wanted, and ``own`` those of the element's
    ``style``, the table has these, ids, ``tag`` and the scopes only, and its rows stay narrow throughout."""
    names = _PASSED if passed is None else {n: _PASSED[n] for n in passed}
    read = PROPERTIES if passed is None else (*names.values(), "display", "opacity", "visibility", *own)
    with collected() as spent:
        elements = once(elements, "elements")
        table = cascaded(elements, combinators, read)
    kind, attr = F.lower("tag"), lambda name: F.try_element_at("attrs", F.lit(name))
    gone = F.coalesce(F.lower(F.rtrim(F.trim(own_value("display")), F.lit(";"))) == "none", F.lit(False)) | ~visible(own_value("opacity"))
    shown = F.lower(F.trim(own_value("visibility")))
    seen = F.when(shown.isin("hidden", "collapse"), "hidden").when(shown.isin("visible", "initial"), "visible")
    said = {**{n: handed_down(p) for n, p in names.items()}, "visibility": seen, "gone": gone}
    if passed is None:
        # references meet the ids alone, and elements by the key that the cascade dealt them by
        ids = elements.select("doc_id", "node_id", attr("id").alias("id")).where("id IS NOT NULL")
        asked = ids.join(referred_ids(elements).hint("merge"), ["doc_id", "id"]).select("doc_id", "node_id", F.lit(True).alias("asked"))
        table = table.join(asked.hint("merge"), ["doc_id", "node_id"], "left")
        table = table.withColumns({**said, "scaled": F.lower(F.coalesce(attr("transform"), F.lit(""))).contains("scale(")})
    else:
        style = F.map_filter("style", lambda k, _: k.isin(*own)) if own else F.lit(None).cast(table.schema["style"].dataType)
        table = table.select("doc_id", "node_id", "parent_id", "tag", style.alias("style"), attr("id").alias("id"), *(c.alias(n) for n, c in said.items()))
        table = table.join(referred_ids(elements).withColumn("asked", F.lit(True)).hint("merge"), ["doc_id", "id"], "left")
    turn = F.when(F.col("gone"), "hidden").when(kind.isin(*INERT), "inert").when(F.col("asked"), "painted").when(kind.isin(*GRADIENTS), "resource").when(kind.isin(*DEFERRED), "unchecked")
    table = table.withColumn("container", turn).drop("asked", "gone")
    rules = {n: F.coalesce(n, f"_{n}") for n in (*names, "visibility")}
    rules["container"] = F.when(F.col("_container").isin("hidden", "inert"), F.col("_container")).otherwise(F.coalesce("container", "_container"))
    if passed is None:
        rules["scaled"] = F.col("scaled") | F.coalesce("_scaled", F.lit(False))
    found = climb(table, rules, F.lit(True), None if passed is None else ("tag", "style"))
    drop(*spent)  # the climb reads its own tables only
    found = found.withColumns({**{n: F.when(F.col(n) != INITIAL, F.col(n)) for n in names}, "visibility": F.coalesce("visibility", F.lit("visible")), "container": F.coalesce("container", F.lit("painted"))})
    return found.withColumn("scope", F.when(F.col("visibility") == "hidden", "hidden").otherwise(F.col("container")))


def drawn(elements: DataFrame, passed: Sequence[str], own: Sequence[str] = (), kept: Sequence[str] | None = None, most: int = WHOLE, plain: DataFrame | None = None) -> DataFrame:
    """``doc_id, node_id, tag, scaled, scope``, the inherited properties ``passed`` of ``resolved`` and the
    ``own`` values of ``style``, as columns ``own_<property>``; where ``kept`` is given, of elements of these scopes.

    Documents of up to ``most`` elements are dealt once and settled whole, larger ones by ``resolved``,
    with the same result.  Selectors are those of descendants.  Where ``plain`` is given it is the same
    table, dealt by document already and with a column ``@name`` for each attribute instead of ``attrs``."""
    names, read = {n: _PASSED[n] for n in passed}, tuple(dict.fromkeys((*(_PASSED[n] for n in passed), "display", "opacity", "visibility", *own)))
    # rows without a document stand alone, and need not meet in one task
    rows = elements.repartition("doc_id", F.when(F.col("doc_id").isNull(), F.col("node_id"))) if plain is None else plain
    attrs = None if plain is None else {c[1:]: F.col(f"`{c}`") for c in plain.columns if c.startswith("@")}
    attr = lambda name: F.try_element_at("attrs", F.lit(name)) if attrs is None else attrs.get(name, F.lit(None).cast("string"))
    sheet = F.when(F.lower("tag") == "style", F.col("text")) if "text" in rows.columns else F.lit(None).cast("string")
    scaled = F.lower(F.coalesce(attr("transform"), F.lit(""))).contains("scale(")
    values = [attr(p).alias(f"attr_{i}") for i, p in enumerate(read) if attrs is None or p in attrs]
    rows = rows.select("doc_id", "node_id", "parent_id", "tag", *(attr(a).alias(a) for a in ("id", "class", "style")), _links(attrs).alias("links"), _used(attr("href")).alias("used"), scaled.alias("scaled"), sheet.alias("sheet"), *values)
    kinds = dict.fromkeys(DEFERRED, whole.UNCHECKED) | dict.fromkeys(GRADIENTS, whole.RESOURCE) | dict.fromkeys(INERT, whole.INERT)
    types, owns = dict(elements.dtypes), [f"own_{p}" for p in own]
    schema = ", ".join([*(f"{c} {types[c]}" for c in ("doc_id", "node_id", "tag")), *(f"`{c}` string" for c in (*names, *owns)), "scaled boolean, scope string, late boolean"])
    found = written(rows.sortWithinPartitions("doc_id", "node_id").mapInArrow(lambda batches: whole.settled(batches, names, own, kinds, LINK, kept, most), schema), "drawn")
    out, late = found.where(~F.col("late")).drop("late"), found.where("late").select("doc_id")
    if late.isEmpty():
        return out
    large = resolved(elements.join(late.hint("merge"), "doc_id", "left_semi"))
    large = large if kept is None else large.where(F.col("scope").isin(*kept))
    return out.unionByName(large.select("doc_id", "node_id", "tag", *names, *(own_value(p).alias(f"own_{p}") for p in own), "scaled", "scope"))


def _own(drawing: DataFrame, prop: str) -> Column:
    """The own value of a property in a drawing of ``resolved`` or ``drawn``."""
    return F.col(f"`own_{prop}`") if f"own_{prop}" in drawing.columns else own_value(prop)


def paint(raw: Column) -> Column:
    """The text of a paint in force: ``currentColor`` is the colour in force, and black where none is."""
    current = F.lower(F.trim(raw)).isin("currentcolor", "current-color")
    return F.when(current, F.coalesce("color", F.lit("#000000"))).otherwise(raw)


def inks(drawing: DataFrame) -> DataFrame:
    """``doc_id, node_id, colour, way`` of every colour that a resolved drawing inks with: fills
    (black where nobody declares one), strokes, and the stops of its gradients."""
    live = drawing.where(~F.col("scope").isin("hidden", "inert", "unchecked"))
    kind = F.lower("tag")
    shape = (F.col("scope") != "resource") & kind.isin(*SHAPES)
    one = lambda way, raw, when: F.when(when, F.struct(F.lit(way).alias("way"), raw.alias("raw")))
    ways = [
        one("stop-color", paint(_own(drawing, "stop-color")), kind == "stop"),
        one("fill (implicit)", F.lit("#000000"), shape & F.col("fill").isNull() & visible(F.col("fill_opacity"))),
        one("fill", paint(F.col("fill")), shape & F.col("fill").isNotNull() & visible(F.col("fill_opacity"))),
        one("stroke", paint(F.col("stroke")), shape & F.col("stroke").isNotNull() & visible(F.col("stroke_opacity"))),
    ]
    # paints are read as rows, so that one reading is planned and none is made for a way that is not there
    each = live.select("doc_id", "node_id", F.explode(F.array_compact(F.array(*ways))).alias("x"))
    return each.select("doc_id", "node_id", "x.way", colour.parse(F.col("x.raw")).alias("colour")).where("colour IS NOT NULL")


def stroked(drawing: DataFrame) -> DataFrame:
    """Painted shapes that declare a stroke."""
    stroke = F.lower(F.trim(F.coalesce("stroke", F.lit(""))))
    return drawing.where((F.col("scope") == "painted") & F.lower("tag").isin(*SHAPES) & ~stroke.isin("", "none", "transparent"))


def strokes(drawing: DataFrame) -> DataFrame:
    """``doc_id, node_id, width`` of the shapes of a resolved drawing whose stroke inks."""
    live = stroked(drawing).where(visible(F.col("stroke_opacity")))
    return live.select("doc_id", "node_id", F.coalesce("stroke_width", F.lit("1")).alias("width"))


def notes(drawing: DataFrame) -> DataFrame:
    """``doc_id, node_id, rule`` of what a resolved drawing has reported without failing: strokes
    under a scaling transform, effects, translucent paint, shapes in definitions that nothing uses."""
    partly = lambda raw: F.coalesce(fraction(raw) > 0, F.lit(False)) & F.coalesce(fraction(raw) < 1, F.lit(False))
    effect = lambda p: F.lower(F.trim(F.coalesce(_own(drawing, p), F.lit("")))).isin("", "none", "inherit", "initial", "unset")
    group = partly(_own(drawing, "opacity"))
    rule = lambda name, when: F.when(when, F.lit(name))
    painted, kind = F.col("scope") == "painted", F.lower("tag")
    found = [
        *(rule("EFFECT_REFERENCE", F.col("scope").isin("painted", "resource") & ~effect(p)) for p in ("filter", "mask", "clip-path")),
        rule("TRANSLUCENT_PAINT", painted & group),
        *(rule("TRANSLUCENT_PAINT", painted & ~group & partly(F.col(c))) for c in ("fill_opacity", "stroke_opacity")),
        rule("UNCHECKED_DEFINITION", (F.col("scope") == "unchecked") & kind.isin(*SHAPES)),
    ]
    own = drawing.select("doc_id", "node_id", F.explode(F.array_compact(F.array(*found))).alias("rule"))
    return own.unionByName(stroked(drawing).where("scaled").select("doc_id", "node_id", F.lit("STROKE_SCALE_TRANSFORM").alias("rule")))
