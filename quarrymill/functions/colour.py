"""Colour expressions on #rrggbb strings and channel columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The colour names of the style language.
NAMES = {
    "aliceblue": "#f0f8ff", "antiquewhite": "#faebd7", "aqua": "#00ffff", "aquamarine": "#7fffd4", "azure": "#f0ffff", "beige": "#f5f5dc",
    "bisque": "#ffe4c4", "black": "#000000", "blanchedalmond": "#ffebcd", "blue": "#0000ff", "blueviolet": "#8a2be2", "brown": "#a52a2a",
    "burlywood": "#deb887", "cadetblue": "#5f9ea0", "chartreuse": "#7fff00", "chocolate": "#d2691e", "coral": "#ff7f50", "cornflowerblue": "#6495ed",
    "cornsilk": "#fff8dc", "crimson": "#dc143c", "cyan": "#00ffff", "darkblue": "#00008b", "darkcyan": "#008b8b", "darkgoldenrod": "#b8860b",
    "darkgray": "#a9a9a9", "darkgreen": "#006400", "darkgrey": "#a9a9a9", "darkkhaki": "#bdb76b", "darkmagenta": "#8b008b",
    "darkolivegreen": "#556b2f", "darkorange": "#ff8c00", "darkorchid": "#9932cc", "darkred": "#8b0000", "darksalmon": "#e9967a",
    "darkseagreen": "#8fbc8f", "darkslateblue": "#483d8b", "darkslategray": "#2f4f4f", "darkslategrey": "#2f4f4f", "darkturquoise": "#00ced1",
    "darkviolet": "#9400d3", "deeppink": "#ff1493", "deepskyblue": "#00bfff", "dimgray": "#696969", "dimgrey": "#696969", "dodgerblue": "#1e90ff",
    "firebrick": "#b22222", "floralwhite": "#fffaf0", "forestgreen": "#228b22", "fuchsia": "#ff00ff", "gainsboro": "#dcdcdc", "ghostwhite": "#f8f8ff",
    "gold": "#ffd700", "goldenrod": "#daa520", "gray": "#808080", "green": "#008000", "greenyellow": "#adff2f", "grey": "#808080",
    "honeydew": "#f0fff0", "hotpink": "#ff69b4", "indianred": "#cd5c5c", "indigo": "#4b0082", "ivory": "#fffff0", "khaki": "#f0e68c",
    "lavender": "#e6e6fa", "lavenderblush": "#fff0f5", "lawngreen": "#7cfc00", "lemonchiffon": "#fffacd", "lightblue": "#add8e6",
    "lightcoral": "#f08080", "lightcyan": "#e0ffff", "lightgoldenrodyellow": "#fafad2", "lightgray": "#d3d3d3", "lightgreen": "#90ee90",
    "lightgrey": "#d3d3d3", "lightpink": "#ffb6c1", "lightsalmon": "#ffa07a", "lightseagreen": "#20b2aa", "lightskyblue": "#87cefa",
    "lightslategray": "#778899", "lightslategrey": "#778899", "lightsteelblue": "#b0c4de", "lightyellow": "#ffffe0", "lime": "#00ff00",
    "limegreen": "#32cd32", "linen": "#faf0e6", "magenta": "#ff00ff", "maroon": "#800000", "mediumaquamarine": "#66cdaa", "mediumblue": "#0000cd",
    "mediumorchid": "#ba55d3", "mediumpurple": "#9370db", "mediumseagreen": "#3cb371", "mediumslateblue": "#7b68ee", "mediumspringgreen": "#00fa9a",
    "mediumturquoise": "#48d1cc", "mediumvioletred": "#c71585", "midnightblue": "#191970", "mintcream": "#f5fffa", "mistyrose": "#ffe4e1",
    "moccasin": "#ffe4b5", "navajowhite": "#ffdead", "navy": "#000080", "oldlace": "#fdf5e6", "olive": "#808000", "olivedrab": "#6b8e23",
    "orange": "#ffa500", "orangered": "#ff4500", "orchid": "#da70d6", "palegoldenrod": "#eee8aa", "palegreen": "#98fb98", "paleturquoise": "#afeeee",
    "palevioletred": "#db7093", "papayawhip": "#ffefd5", "peachpuff": "#ffdab9", "peru": "#cd853f", "pink": "#ffc0cb", "plum": "#dda0dd",
    "powderblue": "#b0e0e6", "purple": "#800080", "rebeccapurple": "#663399", "red": "#ff0000", "rosybrown": "#bc8f8f", "royalblue": "#4169e1",
    "saddlebrown": "#8b4513", "salmon": "#fa8072", "sandybrown": "#f4a460", "seagreen": "#2e8b57", "seashell": "#fff5ee", "sienna": "#a0522d",
    "silver": "#c0c0c0", "skyblue": "#87ceeb", "slateblue": "#6a5acd", "slategray": "#708090", "slategrey": "#708090", "snow": "#fffafa",
    "springgreen": "#00ff7f", "steelblue": "#4682b4", "tan": "#d2b48c", "teal": "#008080", "thistle": "#d8bfd8", "tomato": "#ff6347",
    "turquoise": "#40e0d0", "violet": "#ee82ee", "wheat": "#f5deb3", "white": "#ffffff", "whitesmoke": "#f5f5f5", "yellow": "#ffff00",
    "yellowgreen": "#9acd32",
}
#: Words in place of a colour that name none.
NO_COLOURS = ("none", "transparent", "currentcolor", "inherit", "initial", "unset", "revert", "revert-layer", "auto", "context-fill", "context-stroke", "child", "", "all")


def clamp(x: Column) -> Column:
    return F.least(F.greatest(F.bround(x).cast("int"), F.lit(0)), F.lit(255))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", clamp(r), clamp(g), clamp(b))


def channel(colour: Column, index: int) -> Column:
    return F.conv(F.substring(colour, 2 + 2 * index, 2), 16, 10).cast("int")


def packed(r: Column, g: Column, b: Column) -> Column:
    return r * 65536 + g * 256 + b


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0)).cast("double"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of sRGB channels."""
    linear = lambda c: F.when(c / 255.0 <= 0.03928, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def from_hsl(hue: Column, saturation: Column, lightness: Column) -> Column:
    """#rrggbb of a hue in degrees, and saturation and lightness as shares."""
    top = F.when(lightness <= 0.5, lightness * (1 + saturation)).otherwise(lightness + saturation - lightness * saturation)
    low = 2 * lightness - top

    def part(turn: float) -> Column:
        # pmod keeps the place on the circle in 0..1
        at = F.pmod(hue / 360.0 + turn, F.lit(1.0))
        return F.when(saturation == 0, lightness).when(at < 1 / 6, low + (top - low) * at * 6).when(at < 0.5, top).when(at < 2 / 3, low + (top - low) * (2 / 3 - at) * 6).otherwise(low)

    return to_hex(part(1 / 3) * 255.0, part(0.0) * 255.0, part(-1 / 3) * 255.0)


def _let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def _of_function(s: Column) -> Column:
    """The colour of ``rgb(...)`` or ``hsl(...)`` text; null where it is clear."""

    def made(p: Column) -> Column:
        share = lambda part: F.when(part.endswith("%"), F.regexp_replace(part, "%$", "").try_cast("double") / 100.0)
        channel_of = lambda part: F.coalesce(share(part) * 255.0, part.try_cast("double"))
        number = lambda i, unit: F.regexp_replace(F.get(p, i), unit, "").try_cast("double")
        clear = F.coalesce(F.coalesce(share(F.get(p, 3)), F.get(p, 3).try_cast("double")) <= 0, F.lit(False))
        known = lambda x: F.get(x, 0).isNotNull() & F.get(x, 1).isNotNull() & F.get(x, 2).isNotNull()
        rgb = _let(F.array(*(channel_of(F.get(p, i)) for i in range(3))), lambda c: F.when(known(c), to_hex(F.get(c, 0), F.get(c, 1), F.get(c, 2))))
        hsl = _let(F.array(F.pmod(number(0, "[deg]+$"), F.lit(360.0)), number(1, "%+$") / 100.0, number(2, "%+$") / 100.0), lambda c: F.when(known(c), from_hsl(F.get(c, 0), F.get(c, 1), F.get(c, 2))))
        return F.when(~clear, F.coalesce(F.when(s.startswith("rgb"), rgb).otherwise(hsl), F.concat(F.lit("#"), s)))

    body = F.regexp_extract(s, r"(?s)^(?:rgb|rgba|hsl|hsla)\s*\((.*)\)$", 1)
    return _let(F.filter(F.split(F.trim(body), r"[,\s/]+"), lambda p: p != ""), made)


def parse(raw: Column) -> Column:
    """Any spelling of a colour as #rrggbb; words for no colour, links, variables, zero alpha and
    hex digits of an odd number give null; an unknown word, or a function of too few or broken
    numbers, stays as it is (the latter behind a #), so that it still takes a place of its own."""
    names = F.str_to_map(F.lit(",".join(f"{name}={value}" for name, value in NAMES.items())), F.lit(","), F.lit("="))  # one literal to plan with, not one for each word

    def of_hex(digits: Column) -> Column:
        wide = F.when(F.length(digits).isin(3, 4), F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
        return F.when((F.length(wide) == 6) | (F.length(wide) == 8) & ~wide.endswith("00"), F.concat(F.lit("#"), F.substring(wide, 1, 6)))

    return _let(
        F.lower(F.trim(F.regexp_replace(F.trim(raw), "^['\"]+|['\"]+$", ""))),
        lambda s: F.when(s.isNull() | s.isin(*NO_COLOURS) | s.contains("url(") | s.startswith("var("), None)
        .when(s.rlike("^#[0-9a-f]{3,8}$"), of_hex(F.substring(s, 2, 8)))
        .when(s.rlike(r"(?s)^(rgb|rgba|hsl|hsla)\s*\(.*\)$"), _of_function(s))
        .otherwise(F.coalesce(F.try_element_at(names, s), s)),
    )


def invert(colour: Column) -> Column:
    return to_hex(255 - channel(colour, 0), 255 - channel(colour, 1), 255 - channel(colour, 2))


def swap_channels(colour: Column) -> Column:
    """Red to green, green to blue, blue to red."""
    return to_hex(channel(colour, 2), channel(colour, 0), channel(colour, 1))


def hue_offset(degrees: Column) -> Column:
    """Degrees as a step of an 8-bit hue circle."""
    return F.pmod(F.bround(degrees / 360.0 * 256.0).cast("int"), F.lit(256))
