"""Rule gate, severities, verdicts, requirements: projections inside whole-stage codegen.

A rule is ``(name, predicate)``; a missing reading never fires it.  Registries are
plain lists, so a user adds a rule by appending any boolean Column builder.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.config import COLOUR_EDGES, SPECKLE_EDGES, settings
from quarrymill.functions.numeric import bin_of

Rule = tuple[str, Callable[[Mapping], Column]]


def _limit(options: Mapping, key: str) -> Column:
    """The row's own threshold, where it carries one, over the setting."""
    own = options.get("row_thresholds")
    return F.coalesce(F.try_element_at(F.col(own), F.lit(key)), F.lit(float(options[key]))) if own else F.lit(float(options[key]))


def colours() -> Column:
    return F.coalesce(F.col("declared_colors"), F.col("rendered_colors"))


HARD: list[Rule] = [
    ("ARTWORK_LOST", lambda o: F.coalesce(F.col("fidelity_verdict") == "artwork_lost", F.lit(False)) | F.coalesce(F.col("mae_art") > _limit(o, "mae_art_max"), F.lit(False))),
    ("SILHOUETTE_LOST", lambda o: F.col("silhouette_iou") < _limit(o, "silhouette_iou_min")),
    ("GLOW_AREA_HIGH", lambda o: F.col("glow_area_pct") > _limit(o, "glow_area_pct_max")),
    ("COLOR_CAP_EXCEEDED", lambda o: colours() > _limit(o, "color_cap")),
    ("GEOMETRY_HARD_FAIL", lambda o: F.greatest(*(F.coalesce(F.col(c), F.lit(0)) for c in ("layer_a_hard", "layer_b_hard", "hard"))) > 0),
]
WEAK: list[Rule] = [
    ("SPECKLE_HEAVY", lambda o: F.col("speckle_count") > _limit(o, "speckle_max")),
    ("COLORS_NEAR_CAP", lambda o: colours().between(_limit(o, "color_cap") - 1, _limit(o, "color_cap"))),
    ("LOW_LUMA_CONTRAST", lambda o: F.col("luma_delta") < _limit(o, "luma_delta_min")),
    ("NODE_OVERLOAD", lambda o: F.col("node_count_max") > _limit(o, "node_max")),
    ("BORDERLINE_FIDELITY", lambda o: (F.col("mae_art") > _limit(o, "mae_art_borderline")) & (F.col("mae_art") <= _limit(o, "mae_art_max"))),
]


def fired(rules: list[Rule], options: Mapping) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(p(options), F.lit(False)), F.lit(n)) for n, p in rules)))


def gate(df: DataFrame, user: Mapping | None = None, row_thresholds: str | None = None) -> DataFrame:
    """``disposition`` (ok, demote, drop), ``reasons`` and ``bucket`` beside the row."""
    options = settings(user) | {"row_thresholds": row_thresholds}
    hard, weak = fired(HARD, options), fired(WEAK, options)
    return df.withColumns({"_hard": hard, "_weak": weak}).select(
        *df.columns,
        F.when(F.size("_hard") > 0, "drop").when(F.size("_weak") >= int(options["weak_needed"]), "demote").otherwise("ok").alias("disposition"),
        F.when(F.size("_hard") > 0, F.col("_hard")).otherwise(F.col("_weak")).alias("reasons"),
        bucket_key().alias("bucket"),
    )


def bucket_key() -> Column:
    """``preset|s<bin>|c<bin>|family``; null when the row has neither preset nor colours."""
    key = F.concat(
        F.coalesce("preset", F.lit("")), F.lit("|s"), bin_of(F.coalesce("filter_speckle", F.lit(0)), SPECKLE_EDGES).cast("string"),
        F.lit("|c"), bin_of(F.coalesce(colours(), F.lit(0)), COLOUR_EDGES).cast("string"), F.lit("|"), F.coalesce("prompt_family", F.lit("")),
    )
    return F.when(F.col("preset").isNotNull() | colours().isNotNull(), key)


def bucket_parts(key: Column) -> list[Column]:
    """Preset, speckle bin, colour bin and family of a key; nulls when it is none."""
    pattern = r"^(.*)\|s(\d+)\|c(\d+)\|(.*)$"
    part = lambda i: F.when(key.rlike(pattern), F.regexp_extract(key, pattern, i))
    return [part(1).alias("preset"), part(2).cast("int").alias("speckle_bin"), part(3).cast("int").alias("colour_bin"), part(4).alias("family")]


def severity(rule: Column, advisory: list[str], conditional: Mapping[str, bool] | None = None) -> Column:
    """Conditional rules by their flag, listed ones advisory, any other hard."""
    out = F.when(rule.isin(advisory), "advisory")
    for name, hard in (conditional or {}).items():
        out = out.when(rule == name, "hard" if hard else "advisory")
    return out.otherwise("hard")


def fidelity_verdict(mae: Column, declared: Column, rendered: Column) -> Column:
    """Ordered cases; an unmeasured row counts as faithful."""
    return (
        F.when(mae > 8.0, "artwork_lost")
        .when((F.coalesce(declared, F.lit(0)) != 0) & (rendered < 0.5 * declared), "colour_dropped")
        .when(mae > 1.0, "drift")
        .otherwise("faithful")
    )


def verdict_rank(verdict: Column) -> Column:
    return F.when(verdict == "faithful", 0).when(verdict == "drift", 1).when(verdict == "artwork_lost", 3).otherwise(2)


def _layer(column: str) -> Callable[[Column], Column]:
    status = lambda: F.when(F.col("has_comparison"), F.nullif(F.col(column), F.lit("")))
    return lambda v: F.when(status() == "pass", "PASS").when(status().isNotNull(), "FAIL").otherwise("N/A")


def _back_half(good: Callable[[], Column]) -> Callable[[Column], Column]:
    return lambda v: F.when(~F.coalesce("back_run", F.lit(False)), "N/A").when(F.coalesce(good(), F.lit(False)), "PASS").otherwise("FAIL")


def _at_most(column: str) -> Callable[[Column], Column]:
    return lambda v: F.when(F.col(column).isNull(), "N/A").when(F.col(column) <= v.try_cast("int"), "PASS").otherwise("FAIL")


def _found(column: str) -> Callable[[Column], Column]:
    return lambda v: F.when(F.coalesce(column, F.lit(False)), "PASS").otherwise("PENDING")


#: The eleven requirement checks by type (fixed values); each gives PASS, FAIL, PENDING or
#: N/A of a candidate row: what was not measured is N/A, what a person has still to do PENDING.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "layer_a_passed": _layer("layer_a_status"),
    "layer_b_passed": _layer("layer_b_status"),
    "back_half_passed": _back_half(lambda: F.col("manifest_passed")),
    "tac_exact": _back_half(lambda: F.col("tac_exact")),
    "no_continuous_tone": _back_half(lambda: ~F.col("rendered_continuous_tone")),
    "rendered_colors_le": _at_most("rendered_ink_colors"),
    "node_max_le": _at_most("node_count_max"),
    "vtracer_only": lambda v: F.when(F.coalesce(F.col("backend_kind").isin("vtracer_api", "vtracer_cli"), F.lit(False)), "PASS").otherwise("FAIL"),
    "unique": lambda v: F.when(F.coalesce(F.col("duplicate_of").cast("string"), F.lit("")) == "", "PASS").otherwise("FAIL"),
    "visual_review_present": _found("visual_found"),
    "human_decision_present": _found("decision_found"),
}


def requirement_status(kind: Column, value: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, check in CHECKS.items():
        out = out.when(kind == name, check(value))
    return out.otherwise("N/A")


#: Requirements beyond this are no dimension any more: the board is then refused.
MOST_REQUIREMENTS = 10_000


def board(candidates: DataFrame, requirements: DataFrame) -> DataFrame:
    """Every requirement of every candidate.  The requirements are counted first and must be
    a dimension; they travel as an array literal, so no join is made."""
    rows = requirements.limit(MOST_REQUIREMENTS + 1).collect()
    if len(rows) > MOST_REQUIREMENTS:
        raise ValueError(f"more than {MOST_REQUIREMENTS} requirements")
    if not rows:
        return candidates.select(*candidates.columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in requirements.schema.fields), F.lit(None).cast("string").alias("status")).limit(0)
    each = F.explode(F.array(*(F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in requirements.schema.fields)) for r in rows))).alias("_req")
    return candidates.select("*", each).select(*candidates.columns, "_req.*").withColumn("status", requirement_status(F.col("check_type"), F.col("check_value")))


def closeout_counts(candidates: DataFrame, run: str) -> DataFrame:
    """For each run: back-half runs, reviews, decisions, blocking links, open items, and
    candidates that passed their comparison and that a person labelled for production."""
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return candidates.groupBy(run).agg(
        F.count(F.lit(1)).alias("candidates"), yes("back_run").alias("back_half"), yes("visual_found").alias("reviews"), yes("decision_found").alias("decisions"),
        F.sum(F.coalesce(F.size("missing_links"), F.lit(0))).alias("missing"), F.sum(F.coalesce(F.size("open_items"), F.lit(0))).alias("open"),
        yes(F.col("comparison_passed") & (F.col("decision_label") == "production")).alias("production_ready"),
    )


# Event names, boolean fields and labels that carry a person's action.
POSITIVE_EVENTS = ("star", "pick", "proof", "chosen", "selected")
NEGATIVE_EVENTS = ("unstar", "discard", "delete", "reject", "rejected")
POSITIVE_FIELDS = ("starred", "star", "picked", "pick", "chosen", "selected")
NEGATIVE_FIELDS = ("rejected", "discarded", "deleted")
POSITIVE_LABELS = ("star", "pick", "proof", "production", "style_reference")
NEGATIVE_LABELS = ("discard", "delete", "reject", "needs_retrace")


def _sign_of_name(name: Column, up: tuple, down: tuple) -> Column:
    word = F.lower(F.trim(name))
    return F.when(word.isin(*up), 1).when(word.isin(*down), -1)


def action_sign(columns: Mapping[str, str]) -> Column:
    """+1, -1 or 0 of a line, from what it carries of: its event, a number or flag ``action``
    or ``signal``, boolean fields, its label or decision; the first that says something.
    ``columns`` maps the names a line may carry to their types."""
    found: list[Column] = []
    if "event" in columns:
        found.append(_sign_of_name(F.col("event"), POSITIVE_EVENTS, NEGATIVE_EVENTS))
    for name in ("action", "signal"):
        if columns.get(name) == "boolean":
            found.append(F.when(F.col(name), 1).when(~F.col(name), -1))
        elif name in columns and columns[name] != "string":
            found.append(F.when(F.col(name) > 0, 1).when(F.col(name) < 0, -1))
    for fields, sign in ((POSITIVE_FIELDS, 1), (NEGATIVE_FIELDS, -1)):
        flags = [F.col(f) for f in fields if columns.get(f) == "boolean"]
        if flags:
            found.append(F.when(F.array_contains(F.array(*flags), True), sign))
    labels = [F.nullif(F.col(f), F.lit("")) for f in ("label", "decision") if columns.get(f) == "string"]
    if labels:
        found.append(_sign_of_name(F.coalesce(*labels), POSITIVE_LABELS, NEGATIVE_LABELS))
    return F.coalesce(*found, F.lit(0))


ASPECT_TOLERANCE, BORDER_SIGMA = 0.02, 16.0
RASTER_SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".webp", ".bmp")


def prep_checks(width_mm: float | None, height_mm: float | None, dpi: float | None) -> Column:
    """Checks of a source raster (``ext, mode, w_px, h_px, border_sigma``) as an array of
    ``(check, status)``; a size is compared only where one is ordered."""
    check = lambda name, status: F.struct(F.lit(name).alias("check"), status.alias("status"))
    out = [
        check("format", F.when(F.lower("ext").isin(*RASTER_SUFFIXES), "pass").otherwise("warn")),
        check("color_mode", F.when(F.col("mode").isin("RGB", "RGBA", "L", "LA"), "pass").otherwise("warn")),
        check("alpha", F.when(F.col("mode").isin("RGBA", "LA", "PA"), "warn").otherwise("pass")),
    ]
    if width_mm and height_mm and dpi:
        ordered, source = width_mm / height_mm, F.when(F.col("h_px") > 0, F.col("w_px") / F.col("h_px"))
        small = (F.col("w_px") / dpi * 25.4 < width_mm * 0.9) | (F.col("h_px") / dpi * 25.4 < height_mm * 0.9)
        aspect = F.when(source > 0, check("aspect_ratio", F.when(F.abs(source - ordered) / ordered > ASPECT_TOLERANCE, "fail").otherwise("pass")))
        out += [aspect, check("physical_size", F.when(small, "warn").otherwise("pass"))]
    else:
        out.append(check("geometry", F.lit("info")))
    out.append(check("background", F.when(F.col("border_sigma").isNull(), "info").when(F.col("border_sigma") < BORDER_SIGMA, "pass").otherwise("warn")))
    return F.array_compact(F.array(*out))


def acceptable(checks: Column) -> Column:
    return ~F.exists(checks, lambda c: c["status"] == "fail")


def shared_name_notes(entries: Column) -> Column:
    """One note for each entry ``(label, path, scope)`` that was read from a name which runs share."""
    flat = F.filter(entries, lambda e: e["scope"] == "flat")
    return F.transform(flat, lambda e: F.concat(e["label"], F.lit(" read from the shared flat name '"), F.coalesce(e["path"], F.lit("None")), F.lit("' -- not attributable to this run")))


def kept_parameters(params: Column, available: Column) -> tuple[Column, Column]:
    """Parameters that a backend knows, and the names of the others in order."""
    return F.map_filter(params, lambda k, _: F.array_contains(available, k)), F.array_sort(F.array_except(F.map_keys(params), available))


def recolour_errors(pairs: Column) -> Column:
    """Pairs that are not #rrggbb on both sides; an empty map is an error of its own."""
    plain = lambda x: F.coalesce(F.trim(x).rlike("^#[0-9A-Fa-f]{6}$"), F.lit(False))
    bad = F.map_keys(F.map_filter(pairs, lambda k, v: ~(plain(k) & plain(v))))
    return F.when(F.coalesce(F.size(pairs), F.lit(0)) < 1, F.array(F.lit("recolour map is empty"))).otherwise(F.array_sort(bad))


def disk_gate(free_bytes: Column) -> Column:
    return F.when(free_bytes < 1 << 30, "refuse").when(free_bytes < 2 << 30, "warn").otherwise("ok")


def retention(is_link: Column, age_hours: Column, protected: Column, grace_hours: float) -> Column:
    return F.when(is_link, "skip_symlink").when(protected, "keep_live").when(age_hours < grace_hours, "keep_grace").otherwise("target")


def dataset_outcomes(variants: DataFrame, run: str) -> DataFrame:
    """Counts of the variants asked for by outcome; a variant is skipped where it does not
    apply, faulty where it broke, else written, and without a written one there is no dataset."""
    outcome = F.when(~F.coalesce("applicable", F.lit(False)), "skipped").when(F.col("fault").isNotNull(), "fault").otherwise("written")
    counted = variants.withColumn("_o", outcome)
    of = lambda name: F.count_if(F.col("_o") == name)
    return counted.groupBy(run).agg(F.count(F.lit(1)).alias("asked"), of("written").alias("written"), of("skipped").alias("skipped"), of("fault").alias("faults"), (of("written") > 0).alias("dataset"))
