from pyspark.sql import functions as F

from quarrymill.functions import numeric, text
from quarrymill.operators import rules
from quarrymill.schemas import CANDIDATE

CLEAN = dict(
    id="candidate_01", file="candidate_01.svg", prompt_family=None, prompt=None, preset="poster", filter_speckle=8, hierarchical="stacked", use_palette=False,
    hard=0, advisory=1, layer_a_hard=0, layer_b_hard=0, node_count_max=120, declared_colors=3, rendered_colors=4, fidelity_verdict="faithful", fidelity_measured=True,
    mae_art=0.5, speckle_count=4, glow_area_pct=1.0, luma_delta=30.0, silhouette_iou=0.97, triage=None,
)
CHANGES = [
    ({}, "ok", []),
    ({"mae_art": 8.01}, "drop", ["ARTWORK_LOST"]),
    ({"mae_art": 8.0}, "ok", ["BORDERLINE_FIDELITY"]),
    ({"silhouette_iou": 0.84}, "drop", ["SILHOUETTE_LOST"]),
    ({"declared_colors": None, "rendered_colors": 9}, "drop", ["COLOR_CAP_EXCEEDED"]),
    ({"layer_b_hard": 1, "speckle_count": 99}, "drop", ["GEOMETRY_HARD_FAIL"]),
    ({"speckle_count": 41, "luma_delta": 11.0, "node_count_max": 501}, "demote", ["SPECKLE_HEAVY", "LOW_LUMA_CONTRAST", "NODE_OVERLOAD"]),
    ({"declared_colors": 7}, "ok", ["COLORS_NEAR_CAP"]),
    ({k: None for k in CLEAN if k != "id"}, "ok", []),
    ({"triage": {"speckle_max": 3.0}}, "ok", ["SPECKLE_HEAVY"]),
]


def test_one_field_perturbations(spark):
    rows = [CLEAN | {"id": str(i)} | change for i, (change, _, _) in enumerate(CHANGES)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], CANDIDATE)
    got = {r.id: r for r in rules.gate(df, row_thresholds="triage").collect()}
    for i, (_, disposition, reasons) in enumerate(CHANGES):
        assert (got[str(i)].disposition, got[str(i)].reasons) == (disposition, reasons)
    assert got["0"].bucket == "poster|s2|c1|" and got["8"].bucket is None


def test_gate_stays_in_codegen(spark):
    df = spark.createDataFrame([], CANDIDATE)
    plan = rules.gate(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_text_functions(spark):
    row = spark.createDataFrame([(" Ab, c! ", "translate( 1.239 ,2 )", "-0.001", "M1.005,2 L 3 4.0")], "a string, t string, z string, p string").select(
        text.normal(F.col("a")).alias("n"), text.grams(text.normal(F.col("a"))).alias("g"), text.grams(F.lit("x")).alias("one"), text.grams(F.lit("")).alias("none"),
        text.slug(F.lit("--")).alias("s"), text.number_text(F.lit(-0.001)).alias("z"), numeric.bin_of(F.lit(5), (0, 5, 20, 40)).alias("b"),
    ).first()
    assert row.n == "ab c" and row.g == ["ab", "b ", " c"] and row.one == ["x"] and row.none == []
    assert row.s == "artwork" and row.z == "0" and row.b == 1
