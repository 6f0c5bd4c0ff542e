"""Numbers: bins, safe numbers, units, dates, vectors, hashes of images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points in one unit of a length.
POINTS = {"pt": 1.0, "px": 0.75, "pc": 12.0, "in": 72.0, "cm": 72.0 / 2.54, "mm": 72.0 / 25.4, "q": 72.0 / 101.6}


def bin_of(value: Column, edges) -> Column:
    """Index of the first inclusive upper edge that holds the value; above all: their number."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: value > e))


def half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)


def first_number(*columns: Column) -> Column:
    return F.coalesce(*(c.cast("double") for c in columns))


def length_points(raw: Column, mm_per_unit: float = 25.4 / 96) -> Column:
    """A length with a unit in points; a bare number counts user units; anything else is null."""
    s = F.lower(F.trim(raw))
    number, unit = F.regexp_extract(s, r"^([-+]?[0-9]*\.?[0-9]+(?:e[-+]?[0-9]+)?)\s*([a-z]*)$", 1), F.regexp_extract(s, r"^([-+]?[0-9]*\.?[0-9]+(?:e[-+]?[0-9]+)?)\s*([a-z]*)$", 2)
    value = F.nullif(number, F.lit("")).try_cast("double")
    scale = F.create_map(*[F.lit(x) for pair in POINTS.items() for x in pair])
    return F.when(unit == "", value * (mm_per_unit * 72.0 / 25.4)).otherwise(value * F.try_element_at(scale, unit))


def opacity(raw: Column) -> Column:
    s = F.trim(raw)
    value = F.when(s.endswith("%"), F.regexp_replace(s, "%$", "").try_cast("double") / 100.0).otherwise(s.try_cast("double"))
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def declarations(style: Column) -> Column:
    """``a: b; c: d !important`` as a map of lower-case names to values without the mark.
    The last declaration of a name wins, but an important one yields to important ones only."""
    parts = F.filter(F.split(F.regexp_replace(style, r"(?s)/\*.*?\*/", ""), ";"), lambda p: p.contains(":"))
    name = lambda p: F.lower(F.trim(F.substring_index(p, ":", 1)))
    value = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"^[^:]*:", ""), r"(?i)\s*!\s*important\s*$", ""))
    marked = lambda p: p.rlike(r"(?i)!\s*important\s*$")
    put = lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != name(p)), F.create_map(name(p), value(p)))
    fold = lambda some: F.aggregate(some, F.create_map().cast("map<string,string>"), put)
    plain, important = fold(F.filter(parts, lambda p: ~marked(p))), fold(F.filter(parts, marked))
    return F.map_concat(F.map_filter(plain, lambda k, _: ~F.map_contains_key(important, k)), important)


def specificity(selector: Column) -> Column:
    """Ids, classes and attributes, tags of a selector, in one comparable number."""
    ids, classes = F.regexp_count(selector, F.lit(r"#[\w-]+")), F.regexp_count(selector, F.lit(r"\.[\w-]+|\[[^\]]*\]"))
    tags = F.regexp_count(selector, F.lit(r"(^|[\s>+~])[A-Za-z][\w-]*"))
    return ids * 1_000_000 + classes * 1_000 + tags


def age_seconds(then: Column, now: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(then)


def expired(raw: Column, now: Column, ttl: float) -> Column:
    """A missing time has not expired; one that cannot be read has."""
    parsed = F.try_to_timestamp(raw)
    return F.when(raw.isNull(), False).when(parsed.isNull(), True).otherwise(age_seconds(parsed, now) > ttl)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Clamped to 0..1; 0 when either vector is empty or zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)


def difference_bits(values: Column, width: int) -> Column:
    """Each row's neighbours compared: true where the right one is larger."""
    size = F.size(values)
    places = F.filter(F.sequence(F.lit(0), size - 2), lambda i: i % width != width - 1)
    return F.transform(places, lambda i: F.get(values, i + 1) > F.get(values, i))


def hamming(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))


def spatial_rule(transform: Column, width: Column, height: Column) -> Column:
    """Matrix text of the six frame transforms."""
    f = lambda t, *c: F.format_string(t, *c)
    return (
        F.when(transform == "flip-h", f("matrix(-1 0 0 1 %s 0)", width))
        .when(transform == "flip-v", f("matrix(1 0 0 -1 0 %s)", height))
        .when(transform == "rotate-90", f("matrix(0 1 -1 0 %s 0)", height))
        .when(transform == "rotate-180", f("matrix(-1 0 0 -1 %s %s)", width, height))
        .when(transform == "rotate-270", f("matrix(0 -1 1 0 0 %s)", width))
        .when(transform == "identity", F.lit("matrix(1 0 0 1 0 0)"))
    )
