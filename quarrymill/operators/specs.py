"""Specifications as a relation: one JSON text a row in, its settings with their origin out.

A text that cannot be used gives the first reason in ``problem`` and no settings; nothing raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import colour

#: Printing methods that cut, and so need closed outlines.
CUTTING = ("vinyl", "vinyl_cut", "plotter", "cutting", "cutter", "sticker", "decal", "knife")


def _kind(v: Column, path: str) -> Column:
    """Kind of what stands at a path: BOOLEAN, STRING, OBJECT, ARRAY, a number's, VOID for null; null for nothing."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)


def _there(v: Column, path: str) -> Column:
    return F.coalesce(_kind(v, path) != "VOID", F.lit(False))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _truth(v: Column, path: str) -> Column:
    kind, text = _kind(v, path), _text(v, path)
    return F.when(~_there(v, path), False).when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != "").when(kind.isin("OBJECT", "ARRAY"), ~text.isin("{}", "[]")).otherwise(text.try_cast("double") != 0)


def _number(v: Column, path: str) -> Column:
    """A number, a truth value as 1 or 0, or a text that spells a number; else null."""
    kind, text = _kind(v, path), _text(v, path)
    return F.when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0)).when(~kind.isin("OBJECT", "ARRAY"), F.trim(text).try_cast("double"))


def _whole(v: Column, path: str) -> Column:
    """A number without its fraction, or a text that spells a whole number; else null."""
    number = _number(v, path)
    spelled = (_kind(v, path) != "STRING") | F.trim(_text(v, path)).rlike(r"^[+-]?\d+$")
    return F.when(spelled, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))).cast("long")


def resolved_specs(specs: DataFrame, text: str) -> DataFrame:
    """``specs`` with ``problem`` and the settings: ``allow_raster, raster_source, allow_gradients,
    gradient_source, allow_open, open_source, contradiction, min_stroke_pt, max_colors, max_nodes,
    palette, width_mm, height_mm, ink_limit``; a setting that is not given has its default."""
    v = F.col("_v")
    parsed = specs.withColumn("_v", F.try_parse_json(text))
    method = F.lower(F.trim(F.coalesce(_text(v, "$.print_method"), F.lit(""))))
    number = lambda path, low, strict, whole=False: (
        F.when(_there(v, path) & (_whole(v, path) if whole else _number(v, path)).isNull(), "kind").when(_there(v, path) & ((_number(v, path) <= low) if strict else (_number(v, path) < low)), "range")
    )
    faults = [
        F.when(v.isNull(), "not JSON"), F.when(F.coalesce(_kind(v, "$") != "OBJECT", F.lit(True)), "not an object"), F.when(_there(v, "$.geometry") & (_kind(v, "$.geometry") != "OBJECT"), "geometry"),
        F.when(number("$.geometry.min_stroke_width_pt", 0, False).isNotNull(), "min_stroke_width_pt"), F.when(number("$.max_colors", 0, False, True).isNotNull(), "max_colors"), F.when(number("$.geometry.max_nodes_per_path", 0, True, True).isNotNull() | (_whole(v, "$.geometry.max_nodes_per_path") == 0), "max_nodes_per_path"),
        F.when(_there(v, "$.palette") & (_kind(v, "$.palette") != "ARRAY"), "palette"), F.when(_there(v, "$.dimensions") & (_kind(v, "$.dimensions") != "OBJECT"), "dimensions"),
        *(F.when(_there(v, f"$.dimensions.{k}") & _number(v, f"$.dimensions.{k}").isNull(), f"dimensions.{k}") for k in ("width_mm", "height_mm")), F.when(number("$.ink_limit_percent", 0, True).isNotNull(), "ink_limit_percent"),
    ]
    given = lambda path: _kind(v, path).isNotNull()  # noqa: E731  also as null
    cuts = method.isin(*CUTTING)
    explicit = given("$.geometry.allow_open_paths")
    allow_open = F.when(explicit, _truth(v, "$.geometry.allow_open_paths")).otherwise(~cuts & (method != ""))
    source = F.when(explicit, "geometry.allow_open_paths").when(cuts, F.concat(F.lit("print_method="), method, F.lit(" requires closed outlines"))).when(method != "", F.concat(F.lit("print_method="), method, F.lit(" tolerates open strokes"))).otherwise("default (neither allow_open_paths nor print_method given)")
    origin = lambda name: F.when(given(f"$.geometry.{name}"), f"geometry.{name}").otherwise(f"default (geometry.{name} is not set)")
    palette = F.array_compact(F.transform(F.try_variant_get(v, "$.palette", "array<string>"), colour.parse))
    settings = {
        "allow_raster": _truth(v, "$.geometry.allow_raster_embed"), "raster_source": origin("allow_raster_embed"), "allow_gradients": _truth(v, "$.geometry.allow_gradients"), "gradient_source": origin("allow_gradients"),
        "allow_open": allow_open, "open_source": source, "contradiction": explicit & cuts & allow_open, "min_stroke_pt": F.coalesce(_number(v, "$.geometry.min_stroke_width_pt"), F.lit(0.0)), "max_colors": _whole(v, "$.max_colors"), "max_nodes": _whole(v, "$.geometry.max_nodes_per_path"),
        "palette": F.when(F.size(palette) > 0, palette), "width_mm": _number(v, "$.dimensions.width_mm"), "height_mm": _number(v, "$.dimensions.height_mm"), "ink_limit": _number(v, "$.ink_limit_percent"),
    }
    found = parsed.withColumn("problem", F.coalesce(*faults))
    return found.withColumns({n: F.when(F.col("problem").isNull(), c) for n, c in settings.items()}).drop("_v")
