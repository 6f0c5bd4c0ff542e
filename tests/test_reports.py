"""Reports, specifications, drift and closures: odd inputs and the reasons that they give."""

from quarrymill.operators import elements as el
from quarrymill.operators import plates, prepress, specs


def lines(spark, docs):
    return spark.createDataFrame([(d, n, v) for d, rows in docs.items() for n, v in enumerate(rows)], "doc_id string, n int, value string")


def test_fonts(spark):
    head = "name            type    emb sub uni object"
    docs = {
        "good": [head, "--------- --- ---", "Some Font       Type 1  yes yes no 1"], "bad": [head, "- -", "B Font          Type 1  no  yes no 1", "", "A Font          Type 1  No  yes no 2", "C Font          Type 1  YES yes no 3"],
        "odd": ["name   type   object", "---", "X Y Z"], "none": [head, "---"], "last": ["name            emb", "F               no"],
    }
    got = {r.doc_id: (r.verified, r.missing, r["names"]) for r in prepress.font_findings(lines(spark, docs)).collect()}
    assert got == {"bad": (True, 2, "B Font          Type 1, A Font          Type 1"), "odd": (False, 0, ""), "last": (True, 1, "F")}
    assert prepress.font_findings(lines(spark, docs).limit(0)).count() == 0


def test_images_and_colour_spaces(spark):
    head = "page num type width height color comp bpc enc interp object ID x-ppi y-ppi size ratio"
    row = lambda kind, w, x, y: f" 1 0 {kind} {w} 20 rgb 3 8 jpeg no 7 0 {x} {y} 1K 1%"
    docs = {"a": [head, "---", row("image", 10, 72, 300), row("image", 11, 72, 72), row("SMASK", 12, 1, 1), row("image", 13, "n/a", 1), "1 2"], "b": [head, "---", row("image", 1, 300, 300)], "c": ["page num type", row("image", 1, 1, 1)]}
    got = [(r.doc_id, r.weak, r.width, r.ppi) for r in prepress.image_findings(lines(spark, docs)).collect()]
    assert got == [("a", 2, 10, 72.0)]
    files = spark.createDataFrame([("x", b"../DeviceRGB /ICCBased"), ("y", b"/DeviceCMYK/DeviceRGB"), ("z", b""), ("n", None)], "doc_id string, content binary")
    spaces = prepress.colour_spaces(files)
    assert {r.doc_id: r.spaces for r in spaces.collect()} == {"x": ["ICCBased", "RGB"], "y": ["CMYK", "RGB"], "z": [], "n": []}
    assert [r.doc_id for r in prepress.cmyk_findings(spaces).collect()] == ["x"] and prepress.cmyk_findings(spaces, False).count() == 0


def test_specifications_say_why(spark):
    texts = {
        "{}": (None, False, "default (neither allow_open_paths nor print_method given)"), '{"geometry": null}': (None, False, "default (neither allow_open_paths nor print_method given)"), '{"geometry": {"allow_open_paths": null}, "print_method": "screen"}': (None, False, "geometry.allow_open_paths"),
        '{"print_method": "KNIFE "}': (None, False, "print_method=knife requires closed outlines"), '{"geometry": {"min_stroke_width_pt": "x"}}': ("min_stroke_width_pt", None, None), '{"geometry": {"min_stroke_width_pt": -1}}': ("min_stroke_width_pt", None, None),
        '{"max_colors": -1}': ("max_colors", None, None), '{"max_colors": []}': ("max_colors", None, None), '{"ink_limit_percent": 0}': ("ink_limit_percent", None, None), '{"palette": "red"}': ("palette", None, None), '{"dimensions": 3}': ("dimensions", None, None), "null": ("not an object", None, None), "": ("not JSON", None, None), None: ("not JSON", None, None),
    }
    got = specs.resolved_specs(spark.createDataFrame([(t,) for t in texts], "spec string"), "spec").collect()
    assert {r.spec: (r.problem, r.allow_open, r.open_source) for r in got} == texts


def test_drift(spark):
    pixel = lambda image, y, x, v: (image, y, x, v, v, v)
    before = [pixel("i", y, x, 255 if x < 3 else 0) for y in range(4) for x in range(4)] + [pixel("ink", 0, x, 0) for x in range(3)]
    after = [pixel("i", y, x, 0 if (y, x) in ((0, 0), (0, 1), (2, 2)) else 9 if (y, x) == (3, 3) else 255 if x < 3 else 8) for y in range(4) for x in range(4)] + [pixel("ink", 0, x, 0) for x in range(2)] + [pixel("new", 0, 0, 1)]
    kind = "image string, y long, x long, r long, g long, b long"
    got = {r.image: (r.changed, r.ink, r.valid, r.lost, r.gained, r.gap) for r in plates.drift(spark.createDataFrame(before, kind), spark.createDataFrame(after, kind), "image").collect()}
    assert got == {"i": (25.0, 25.0, True, 18.75, 6.25, 2), "ink": (0.0, 100.0, False, 0.0, 0.0, 0)}


def test_border_ring(spark):
    flat = [("flat", y, x, 10, 20, 30) for y in range(5) for x in range(5)]
    flat[12] = ("flat", 2, 2, 255, 255, 255)
    mixed = [("mixed", y, x, 255 * (x % 2), 0, 0) for y in range(3) for x in range(3)]
    got = {r.image: r for r in plates.border_ring(spark.createDataFrame(flat + mixed, "image string, y long, x long, r long, g long, b long"), "image").collect()}
    # the value's own spread over the channels counts, as it does in the rule
    assert got["flat"].seen == 20 and (got["flat"].r, got["flat"].g, got["flat"].b) == (10, 20, 30) and got["flat"].status == "pass" and got["mixed"].status == "warn"


def test_closures(spark):
    kind = "doc_id string, closes long, moves long"
    before, after = spark.createDataFrame([("a", 1, 2), ("b", 3, 3), ("c", 0, 0), ("d", 1, 1)], kind), spark.createDataFrame([("a", 1, 2), ("b", 2, 3), ("e", 0, 1)], kind)
    assert sorted(map(tuple, el.closure_changes(before, after).collect())) == [("b", 3, 2, 3, 3), ("d", 1, 0, 1, 0), ("e", 0, 0, 0, 1)]
