"""Findings about finished documents, from the reports of tools as lines: ``doc_id, n, value`` with the header at n = 0.

A report whose header lacks its column cannot be read; it is told apart from one without findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The least resolution of a placed image, and the markers of colour spaces in a document's bytes.
LEAST_PPI = 300.0
COLOUR_SPACES = {"RGB": b"/DeviceRGB", "CMYK": b"/DeviceCMYK", "Gray": b"/DeviceGray", "ICCBased": b"/ICCBased"}
#: Names that a finding shows.
SHOWN = 5


def _with_header(lines: DataFrame) -> DataFrame:
    """Each report's rows beside its header; blank lines and rules of dashes go."""
    lines = lines.where("doc_id IS NOT NULL").where((F.col("n") == 0) | ~F.col("value").rlike("^[- ]*$"))
    header = F.max(F.when(F.col("n") == 0, F.col("value"))).over(Window.partitionBy("doc_id"))  # a report has one
    return lines.withColumn("header", header).where("n > 0 AND header IS NOT NULL")


def fonts(lines: DataFrame) -> DataFrame:
    """``doc_id, n, name, embedded`` of a font report; ``embedded`` is null where the header has no such column."""
    rows = _with_header(lines)
    at, end = F.instr("header", F.lit("emb")), F.instr("header", F.lit("uni"))
    cut = F.when(end > at, end).otherwise(F.length("header") + 1)
    flag = F.lower(F.get(F.split(F.trim(F.substring(F.col("value"), at, cut - at)), r"\s+"), 0))
    return rows.select("doc_id", "n", F.when(at > 0, F.trim(F.substring(F.col("value"), F.lit(1), at - 1))).alias("name"), F.when(at > 0, flag == "yes").alias("embedded"))


def font_findings(lines: DataFrame) -> DataFrame:
    """FONT_EMBED: ``doc_id, verified, missing, names`` of documents with fonts that are not embedded (the first
    few by name), or whose report cannot be read."""
    found = fonts(lines).groupBy("doc_id").agg(F.count_if(~F.col("embedded")).alias("missing"), F.count("embedded").alias("seen"), F.collect_list(F.when(~F.col("embedded"), F.struct("n", "name"))).alias("all"))
    names = F.array_join(F.slice(F.array_sort("all")["name"], 1, SHOWN), ", ")
    return found.select("doc_id", (F.col("seen") > 0).alias("verified"), "missing", names.alias("names")).where("NOT verified OR missing > 0")


def images(lines: DataFrame) -> DataFrame:
    """``doc_id, n, width, height, x_ppi, y_ppi`` of placed images; masks and rows that cannot be read go."""
    parts = F.split(F.trim("value"), r"\s+")
    at = lambda i, kind: F.get(parts, i).try_cast(kind)
    rows = _with_header(lines).where(F.col("header").contains("x-ppi") & (F.size(parts) >= 3) & ~F.lower(F.get(parts, 2)).isin("smask", "mask"))
    found = rows.select("doc_id", "n", at(3, "int").alias("width"), at(4, "int").alias("height"), F.round(at(12, "double"), 1).alias("x_ppi"), F.round(at(13, "double"), 1).alias("y_ppi"))
    return found.dropna()


def image_findings(lines: DataFrame, least: float = LEAST_PPI) -> DataFrame:
    """IMAGE_RESOLUTION: ``doc_id, weak, width, height, ppi``: images below the least resolution, and the worst."""
    ppi = F.least("x_ppi", "y_ppi")
    weak = images(lines).withColumn("ppi", ppi).where(F.col("ppi") < least)
    worst = weak.groupBy("doc_id").agg(F.count(F.lit(1)).alias("weak"), F.min_by(F.struct("width", "height", "ppi"), F.struct("ppi", "n")).alias("w"))
    return worst.select("doc_id", "weak", "w.width", "w.height", "w.ppi")


def colour_spaces(contents: DataFrame) -> DataFrame:
    """``doc_id, spaces`` (sorted) that the bytes of documents (``doc_id, content``) name."""
    named = [F.when(F.contains("content", F.lit(bytearray(mark))), name) for name, mark in COLOUR_SPACES.items()]
    return contents.select("doc_id", F.array_sort(F.array_compact(F.array(*named))).alias("spaces"))


def cmyk_findings(spaces: DataFrame, required: bool = True) -> DataFrame:
    """CMYK_REQUIRED: documents whose known colour spaces lack CMYK; one of no known space is not judged."""
    return spaces.where(F.lit(required) & (F.size("spaces") > 0) & ~F.array_contains("spaces", "CMYK"))
