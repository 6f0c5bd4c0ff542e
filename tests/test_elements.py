"""Element rules on small drawings, path data, and the learning rules that must keep everyone."""

import math

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import numeric, text
from quarrymill.operators import elements as el
from quarrymill.operators import learning, rules
from quarrymill.schemas import ELEMENTS


def drawing(spark, rows):
    return spark.createDataFrame([("d", n, up, 0, 0, tag, attrs) for n, up, tag, attrs in rows], ELEMENTS)


@pytest.mark.parametrize("data,want", [
    ("M0 0 L10 0 L10 10 Z", ("drawn", 3, 1, 0, 1, 1)), ("M0,0l5-5", ("drawn", 1, 1, 1, 0, 1)), (None, ("empty", 0, 0, 0, 0, 0)), (" ", ("empty", 0, 0, 0, 0, 0)), ("M1 1", ("empty", 0, 0, 0, 0, 1)),
    ("M1 1 L1 1", ("zero_length", 1, 1, 0, 0, 1)), ("M0 0 L3 0 Z", ("zero_area", 2, 1, 0, 1, 1)), ("M0 0 h3 v3 H0 z m5 5 l1 1", ("drawn", 5, 2, 1, 1, 2)), ("M0 0 L1", ("unparseable", 0, 0, 0, 0, 1)), ("1 2", ("unparseable", 0, 0, 0, 0, 0)), ("L1 1", ("unparseable", 0, 0, 0, 0, 0)),
    ("M0 0 Q1 1 2 0 T4 0 A1 1 0 0 1 0 0Z", ("drawn", 3, 1, 0, 1, 1)), ("M.5.5 1e1-1E1", ("drawn", 1, 1, 1, 0, 1)),
])
def test_path_measures(data, want):
    assert el.path_measures(data) == want


def test_rules_over_a_drawing(spark):
    rows = [
        (0, None, "svg", {"width": "10mm", "height": "auto", "viewBox": "0 0 96 192"}), (1, 0, "g", {"fill": "RED", "stroke": "blue", "stroke-width": "0.1pt"}), (2, 1, "path", {"d": "M0 0 L1 1", "style": "fill: #0f0 !important; fill: lime"}), (3, 1, "rect", {"fill": "currentColor", "color": "#123456", "stroke": "none"}),
        (4, 0, "defs", {}), (5, 4, "linearGradient", {"id": "g"}), (6, 4, "circle", {"id": "c", "fill": "url(#g)", "opacity": "50%"}), (7, 0, "use", {"href": "#c", "stroke": "#000", "stroke-width": "wide"}), (8, 0, "use", {"href": "x.svg#c", "display": "none"}), (9, 0, "image", {}), (10, 0, "clipPath", {"id": "k"}), (11, 10, "rect", {"filter": "url(#none)"}),
        (12, 4, "symbol", {}), (13, 12, "path", {"d": ""}),
    ]
    table = drawing(spark, rows)
    assert sorted((r.node_id, r.kind) for r in el.raster_sources(table).collect()) == [(8, "use"), (9, "image")]
    colours = {r.colour: r.n for r in el.colours_in_force(table).collect()}
    # the first use is black and stroked so; what is hidden, clipping or unused inks nothing; the gradient is no colour
    assert colours == {"#00ff00": 1, "#0000ff": 1, "#123456": 1, "#000000": 2}
    assert el.colour_count(table, 3).count() == 1 and el.colour_count(table, 4).count() == 0
    assert [r.colour for r in el.off_palette(table, ["#000000", "#00FF00", "#123456"]).collect()] == ["#0000ff"]
    assert sorted((r.node_id, r.kind, r.target) for r in el.gradients(table).collect()) == [(5, "definition", "g"), (6, "fill", "g")]
    assert sorted((r.prop, r.target, r.kind) for r in el.id_references(table).collect()) == [("fill", "g", "linearGradient"), ("filter", "none", None), ("href", "c", "circle")]
    assert sorted((r.node_id, r.points and round(r.points, 6)) for r in el.thin_strokes(table, 0.5).collect()) == [(2, 0.1), (7, None)]
    assert [(r.axis, round(r.actual_mm, 3)) for r in el.dimensions(table, 10.4, 50.0).collect()] == [("height", 50.8)]
    scopes = {r.node_id: r.scope for r in el.paint_scopes(table).collect()}
    assert (scopes[2], scopes[8], scopes[11], scopes[13], scopes[5]) == ("painted", "hidden", "inert", "unchecked", "painted")
    assert sorted((r.node_id, r.rule) for r in el.notes(table).collect()) == [(6, "TRANSLUCENT_PAINT"), (13, "UNCHECKED_DEFINITION")]
    paths = el.path_table(table)
    assert sorted((r.node_id, r.rule) for r in el.path_findings(paths).collect()) == [(2, "OPEN_PATH"), (13, "ZERO_AREA_PATH")]
    assert el.path_findings(paths, allow_open=True).count() == 1 and el.path_totals(paths, 0).first().over_limit == 1
    assert el.path_table(table.limit(0)).count() == 0


def test_important_declarations_win(spark):
    got = spark.createDataFrame([("a: 1 !important; A: 2; b: 3; b: 4; /* c: 5; */ d:x:y",)], "s string").select(numeric.declarations(F.col("s")).alias("m"), numeric.opacity(F.lit(None).cast("string")).alias("o")).first()
    assert got.m == {"a": "1", "b": "4", "d": "x:y"} and got.o is None


def test_slots_drop_nobody():
    keys = [(float(i // 2), 0.0, 0.0, 0.0, f"c{i:02d}") for i in range(30)]
    names = [k[-1] for k in keys]
    for window, slots in ((8, 1), (8, 3), (1, 1), (0, 2), (40, 2), (4, 9)):
        order = learning.slotted(keys, names, window, slots)
        assert sorted(order) == list(range(30))
        kept = window - min(slots, window - 1) if 1 < window < 30 else 30
        assert order[:kept] == list(range(30))[:kept]
        if 1 < window < 30:  # from outside the window, and none but the nearest to the cut
            drawn = order[kept:window]
            assert all(window <= i < window + 4 * slots + 2 for i in drawn) and order[window:] == sorted(order[window:])
    assert learning.slotted(keys[::-1], names[::-1], 8, 2) == [29 - i for i in learning.slotted(keys, names, 8, 2)]


def test_cold_order_puts_unmeasured_last(spark):
    rows = [("a", 0, 0, 5.0), ("b", None, 0, 0.0), ("c", 0, None, 0.0), ("d", 0, 0, None), ("e", 1, 9, 2.0), ("f", 0, 0, -3.0)]
    df = spark.createDataFrame(rows, "id string, hard int, advisory int, mae_art double")
    assert [r.id for r in df.orderBy(*learning.ranker_order({"kind": "cold"}, "id")).collect()] == ["f", "a", "e", "d", "c", "b"]


def test_bandit_without_choice(spark):
    stats = spark.createDataFrame([("a", 5, 5, "2024-01-01T00:00:00", False), ("b", 5, 0, "2024-01-01T00:00:00", True)], "bucket string, attempts long, successes long, last_t string, veto boolean")
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert learning.choose_bucket(stats, now, seed=1).first().bucket == "a"
    assert tuple(learning.choose_bucket(stats, now, seed=1, veto=["a"]).first()) == (None, "none", "every bucket is vetoed")
    assert tuple(learning.choose_bucket(stats.limit(0), now, seed=1).first()) == (None, "none", "no buckets given")


def test_cold_start_takes_settings_above_the_default(spark):
    df = spark.createDataFrame([(f"j{j}/{i}", float(i)) for j in range(40) for i in range(2)], "key string, x double")
    pairs = spark.createDataFrame([(f"j{j}", f"j{j}/1", f"j{j}/0") for j in range(40)], "job string, winner string, loser string")
    assert learning.fit_ranker(df, pairs, "key", ["x"], cold_start_picks=40, iterations=1)["kind"] == "pairwise"
    assert learning.fit_ranker(df, pairs, "key", ["x"], cold_start_picks=41)["kind"] == "cold"
    assert learning.fit_ranker(df, None, "key", ["x"])["kind"] == "cold"
    model = learning.fit_ranker(df, pairs, "key", ["x"], iterations=2)
    assert learning.model_of([dict(zip(("feature", "ord", "weight", "mean", "scale"), r, strict=True)) for r in learning.model_rows(model)]) == model
    assert math.isfinite(model["weights"]["x"])


def test_names_and_maps(spark):
    row = spark.range(1).select(
        text.internal(F.lit("poster-candidate-07.svg")).alias("i"), text.internal(F.lit("x.svg")).alias("n"), text.published(F.lit(""), F.lit("candidate_07.svg")).alias("p"),
        text.csv(F.lit(None).cast("string"), F.array().cast("array<string>"), "d").alias("c"), rules.recolour_errors(F.create_map(F.lit("#00000G"), F.lit("#000000"))).alias("e"),
        rules.acceptable(F.array(F.struct(F.lit("a").alias("check"), F.lit("fail").alias("status")))).alias("ok"),
    ).first()
    assert tuple(row) == ("candidate_07.svg", "x.svg", "candidate_07.svg", "d", ["#00000G"], False)
