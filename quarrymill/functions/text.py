"""Text expressions: normal form, grams, slugs, numbers in text, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(s: Column) -> Column:
    """Lower case; letters, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def grams(s: Column, n: int = 2) -> Column:
    """Overlapping character n-grams; a shorter text is one gram, an empty one none."""

    def of(c: Column) -> Column:
        """Of an array of characters: taking one costs the same anywhere in a long text."""
        many = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.array_join(F.slice(c, i + 1, n), ""))
        return F.when(F.size(c) >= n, many).when(F.size(c) > 0, F.array(F.array_join(c, ""))).otherwise(F.array().cast("array<string>"))

    chars = F.filter(F.split(s, ""), lambda x: x != "")
    # a lambda variable, so that the text's own expression is evaluated once and not for each gram
    return F.get(F.transform(F.array(chars), of), F.lit(0))


def slug(s: Column, default: str = "artwork") -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(default))


def number_text(x: Column, places: int = 2) -> Column:
    """Fixed places without trailing zeros and without a negative zero."""
    fixed = F.format_string(f"%.{places}f", x)
    bare = F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(bare.isin("-0", ""), "0").otherwise(bare)


def round_numbers(s: Column, places: int = 2) -> Column:
    """Every number in a string, rounded: numbers and the text between are zipped again."""
    number = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
    found = F.regexp_extract_all(s, F.lit(number), F.lit(0))
    between = F.split(s, number)
    rounded = F.concat(F.transform(found, lambda x: number_text(x.cast("double"), places)), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, rounded, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def path_data(s: Column) -> Column:
    """Path data with rounded numbers, one space between tokens and none around commands."""
    spaced = F.regexp_replace(round_numbers(F.regexp_replace(s, ",", " ")), r"\s*([A-Za-z])\s*", " $1 ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def transform_text(s: Column) -> Column:
    """Transform lists with rounded numbers, one comma between arguments and one space between functions."""
    tight = F.regexp_replace(F.regexp_replace(s, r"\s*([(),])\s*", "$1"), r"\s+", " ")
    return F.trim(F.regexp_replace(round_numbers(tight), r"(?<=\d) (?=-?\d)", ","))


def markup_normal(s: Column) -> Column:
    """Text-level normal form of markup: no comments, no ids, no blanks between tags, blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", ""), r"""\s+id\s*=\s*("[^"]*"|'[^']*')""", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), "> <", "><"))


def digest(s: Column) -> Column:
    return F.sha2(s.cast("binary"), 256)


def pair_map(s: Column) -> Column:
    """``a=b,c=d`` as a map."""
    return F.str_to_map(s, F.lit(","), F.lit("="))


def csv(value: Column, listed: Column, default: str) -> Column:
    """A comma string from a string or a list, whichever there is; blank items go."""
    items = F.array_join(F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != ""), ",")
    return F.when(F.coalesce(value, F.lit("")) != "", value).when(F.size(listed) > 0, items).otherwise(default)


def flattened(texts: dict[str, Column], lists: dict[str, Column]) -> Column:
    """A record as text: names in order, each with its value; lists of strings are sorted."""
    values = {k: F.coalesce(v, F.lit("")) for k, v in texts.items()} | {k: F.array_join(F.array_sort(v), " ") for k, v in lists.items()}
    return F.concat_ws(" ", *(part for name in sorted(values) for part in (F.lit(name), values[name])))


def published(slug_value: Column, name: Column) -> Column:
    """The name under which a candidate's file is given out; without a job's name its own."""
    pattern = r"^candidate_(\d+)(\..*)?$"
    given = F.concat(slug_value, F.lit("-candidate-"), F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2))
    return F.when((F.coalesce(slug_value, F.lit("")) != "") & name.rlike(pattern), given).otherwise(name)


def internal(name: Column) -> Column:
    """The pipeline's own spelling of a given-out name; any other name stays."""
    pattern = r"candidate-(\d+\.[A-Za-z]+)$"
    return F.when(name.rlike(pattern), F.concat(F.lit("candidate_"), F.regexp_extract(name, pattern, 1))).otherwise(name)
