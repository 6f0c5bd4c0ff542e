"""Style sheets, selectors, the cascade, scopes, digests and colours, against walks down small trees."""

import random

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import colour
from quarrymill.operators import canonical, cascade, scopes
from quarrymill.schemas import ELEMENTS

SCHEMA = ELEMENTS + ", text string"


def elements(spark, rows):
    """Rows of ``doc, node, parent, tag, attrs[, text]`` in document order."""
    depth, turn, out = {}, {}, []
    for doc, node, up, tag, attrs, *text in rows:
        depth[doc, node] = 0 if up is None else depth[doc, up] + 1
        turn[doc, up] = turn.get((doc, up), -1) + 1
        out.append((doc, node, up, turn[doc, up], depth[doc, node], tag, attrs, text[0] if text else None))
    return spark.createDataFrame(out, SCHEMA)


def random_tree(rng, doc, size, deep=False):
    """A tree in document order: each node hangs on the last one or on one of its ancestors."""
    rows, path = [(doc, 0, None, "svg", {})], [0]
    for node in range(1, size):
        if not deep:
            del path[rng.randrange(1, len(path) + 1) :]
        attrs = {"id": f"i{node}"}
        if rng.random() < 0.6:
            attrs["class"] = " ".join(rng.sample(["a", "B", "c"], rng.randrange(1, 3)))
        if rng.random() < 0.4:
            attrs["fill"] = rng.choice(["red", "inherit", "none", f"url(#i{rng.randrange(size)})", "initial"])
        if rng.random() < 0.4:
            attrs["style"] = rng.choice(["display:none", "opacity:0", "visibility:hidden", "visibility:visible", "stroke:blue", "fill: lime !important", "opacity: 50%", "display: none;"])
        rows.append((doc, node, path[-1], rng.choice(["g", "path", "rect", "defs", "clipPath", "linearGradient", "stop", "use", "symbol"]), attrs))
        path.append(node)
    return rows


def test_style_rules(spark):
    sheet = """/* a{fill:red} */ @charset "x"; a, .b { fill: red; FILL: blue !important; stroke : none }
    @media screen { c { fill: green } @media print { d { fill: green } } } @media print { e{fill:tan} @media (max-width:9) and print { f{fill:tan} } @font-face { src: x } }
    @keyframes k { from { fill: red } } g > h{stroke-width: 2pt !important; stroke-width:3pt}"""
    got = cascade.style_rules(spark.createDataFrame([("d", 3, sheet), ("e", 1, None), ("f", 1, "broken {")], "doc_id string, node_id long, text string")).collect()
    assert sorted((r.selector, r.prop, r.value, r.important) for r in got) == [
        (".b", "fill", "blue", True), (".b", "stroke", "none", False), ("a", "fill", "blue", True), ("a", "stroke", "none", False), ("e", "fill", "tan", False), ("f", "fill", "tan", False), ("g > h", "stroke-width", "3pt", False),
    ]


def selects(rows, node, parts):
    """Whether (combinator, compound) parts, matched from the right, select the node."""
    by = {r[1]: r for r in rows}
    kids = {}
    for r in rows:
        kids.setdefault(r[2], []).append(r[1])

    def fits(n, part):
        own = by[n]
        tag, classes, ident = part
        return (tag is None or own[3].lower() == tag) and (ident is None or own[4].get("id") == ident) and classes <= set(own[4].get("class", "").lower().split())

    def walk(n, k):
        if not fits(n, parts[k][1]):
            return False
        if k == 0:
            return True
        up, beside = by[n][2], kids[by[n][2]]
        at = beside.index(n)
        if parts[k][0] == ">":
            return up is not None and walk(up, k - 1)
        if parts[k][0] == "+":
            return at > 0 and walk(beside[at - 1], k - 1)
        if parts[k][0] == "~":
            return any(walk(x, k - 1) for x in beside[:at])
        while up is not None:
            if walk(up, k - 1):
                return True
            up = by[up][2]
        return False

    return walk(node, len(parts) - 1)


def test_selectors_against_a_walk(spark, monkeypatch):
    monkeypatch.setattr(cascade, "BLOCK", 7)
    rng = random.Random(5)
    trees = [random_tree(rng, f"d{k}", 40, deep=k == 3) for k in range(4)]
    selectors = []
    for _ in range(14):
        parts, text = [], ""
        for k in range(rng.randrange(1, 4)):
            tag, classes, ident = rng.choice([None, "g", "path", "rect"]), set(rng.sample(["a", "b"], rng.randrange(2))), None
            if tag is None and not classes:
                ident = f"i{rng.randrange(40)}"
            mark = rng.choice([" ", " ", ">", "+", "~"])
            parts.append((mark, (tag, classes, ident)))
            text += ("" if k == 0 else " " if mark == " " else f" {mark} ") + (tag or "") + "".join(f".{c.upper()}" for c in classes) + (f"#{ident}" if ident else "")
        selectors.append((text, parts))
    selectors = list(dict(selectors).items())
    sheet = "".join(f"{t}{{fill:red}}" for t, _ in selectors) + "* {fill:red} a[x]{fill:red} a:hover{fill:red}"
    view = elements(spark, [r for t in trees for r in t])
    rules = cascade.style_rules(spark.createDataFrame([(f"d{k}", 0, sheet) for k in range(4)], "doc_id string, node_id long, text string"))
    found = cascade.selector_matches(rules, view, " >+~").join(rules.select("doc_id", "rule", "selector").distinct(), ["doc_id", "rule"]).collect()
    got = {(r.selector, r.doc_id, r.node_id) for r in found}
    assert got == {(text, t[0][0], r[1]) for text, parts in selectors for t in trees for r in t if selects(t, r[1], parts)} and got
    plain = cascade.selector_matches(rules, view).join(rules.select("doc_id", "rule", "selector").distinct(), ["doc_id", "rule"]).collect()
    assert {r.selector for r in plain} == {s for s, *_ in got if not set(s) & set(">+~")}
    assert cascade.selector_matches(rules, view.limit(0)).count() == 0


def test_the_cascade_ranks(spark):
    sheet = "rect{fill:css} .k{fill:cls} #x{stroke:id} rect{stroke:tag} .k{color:one} .k{color:two} rect{stop-color:imp !important}"
    rows = [("d", 0, None, "svg", {}), ("d", 1, 0, "style", {}, sheet), ("d", 2, 0, "rect", {"id": "x", "class": "k", "fill": "attr", "color": "attr", "style": "stop-color:inline; color: own"}), ("d", 3, 0, "rect", {"fill": "attr", "style": "fill:a !important; fill:b; stop-color: in !important"}), ("d", 4, 0, "path", {"fill": "attr"})]
    got = {r.node_id: {k: (v.value, v.source) for k, v in r["style"].items()} for r in cascade.cascaded(elements(spark, rows)).collect()}
    assert got[2] == {"fill": ("cls", "css"), "stroke": ("id", "css"), "color": ("own", "style"), "stop-color": ("imp", "css")}
    assert got[3] == {"fill": ("b", "style"), "stroke": ("tag", "css"), "stop-color": ("in", "style")} and got[4] == {"fill": ("attr", "attr")}


def walked(rows):
    """Scopes and inherited fills by going down the tree, as the rules are stated."""
    import re

    asked = {m for r in rows for v in r[4].values() for m in re.findall(r"url\(#([^)]+)\)", v)}
    state, out = {None: ("painted", "visible", None)}, {}
    for _, node, up, tag, attrs, *_ in rows:
        style = dict(p.split(":") for p in attrs.get("style", "").rstrip(";").split("; ") if p)
        style = {k.strip(): v.strip().removesuffix("!important").strip() for k, v in style.items()}
        scope, shown, fill = state[up]
        shown = {"hidden": "hidden", "visible": "visible"}.get(style.get("visibility"), shown)
        own = style.get("fill", attrs.get("fill"))
        fill = fill if own in (None, "inherit") else "initial" if own == "initial" else own
        if scope not in ("hidden", "inert"):
            kind = tag.lower()
            scope = "hidden" if style.get("display") == "none" or style.get("opacity") == "0" else "inert" if kind == "clippath" else "painted" if attrs.get("id") in asked else "resource" if kind == "lineargradient" else "unchecked" if kind in ("defs", "symbol") else scope
        state[node] = scope, shown, fill
        out[node] = "hidden" if shown == "hidden" else scope, None if fill == "initial" else fill
    return out


def test_scopes_against_a_walk(spark):
    rng = random.Random(9)
    trees = [random_tree(rng, f"d{k}", 45, deep=k % 4 == 3) for k in range(8)]
    got = scopes.resolved(elements(spark, [r for t in trees for r in t])).collect()
    assert {(r.doc_id, r.node_id): (r.scope, r.fill) for r in got} == {(t[0][0], n): v for t in trees for n, v in walked(t).items()}
    assert scopes.resolved(elements(spark, trees[0]).limit(0)).count() == 0


def test_inks_strokes_and_notes(spark):
    rows = [
        ("d", 0, None, "svg", {"color": "teal"}), ("d", 1, 0, "linearGradient", {}), ("d", 2, 1, "stop", {"stop-color": "currentColor"}), ("d", 3, 1, "rect", {"fill": "red"}), ("d", 4, 0, "g", {"stroke": "#0f0", "stroke-width": "2pt", "transform": "matrix(1) SCALE(2)"}), ("d", 5, 4, "path", {"fill-opacity": "0"}), ("d", 6, 4, "rect", {"stroke-opacity": "0%", "fill": "currentcolor"}),
        ("d", 7, 4, "g", {"fill": "red"}), ("d", 8, 0, "mask", {}), ("d", 9, 8, "circle", {"fill": "red"}), ("d", 10, 0, "path", {"opacity": "0.5", "stroke-opacity": "0.5", "filter": "url(#f)"}), ("d", 11, 0, "text", {"fill-opacity": "25%", "mask": "none"}),
    ]
    drawing = scopes.resolved(elements(spark, rows))
    assert sorted((r.node_id, r.way, r.colour) for r in scopes.inks(drawing).collect()) == [(2, "stop-color", "#008080"), (5, "stroke", "#00ff00"), (6, "fill", "#008080"), (10, "fill (implicit)", "#000000"), (11, "fill (implicit)", "#000000")]
    assert sorted((r.node_id, r.width) for r in scopes.strokes(drawing).collect()) == [(5, "2pt")]
    assert sorted((r.node_id, r.rule) for r in scopes.notes(drawing).collect()) == [(5, "STROKE_SCALE_TRANSFORM"), (6, "STROKE_SCALE_TRANSFORM"), (9, "UNCHECKED_DEFINITION"), (10, "EFFECT_REFERENCE"), (10, "TRANSLUCENT_PAINT"), (11, "TRANSLUCENT_PAINT")]


def test_digests_of_trees(spark, monkeypatch):
    monkeypatch.setattr(canonical, "BLOCK", 2)
    shape = lambda doc, a, b: [(doc, 0, None, "svg", {}), (doc, 1, 0, "g", {"x": "1", "y": "2"}), (doc, 2, 1, a, {}), (doc, 3, 1, b, {"k": "v"}), (doc, 4, 0, "path", {})]
    rows = shape("a", "p", "q") + [(*r[:4], dict(reversed(r[4].items()))) for r in shape("b", "p", "q")] + shape("c", "q", "p") + [("d", 0, None, "svg", {})] + [("d", n, 0, "p", {}) for n in range(1, 8)]
    got = {(r.doc_id, r.node_id): (r.digest, r.nodes) for r in canonical.tree_digests(elements(spark, rows)).collect()}
    assert [got["a", n] for n in range(5)] == [got["b", n] for n in range(5)] and got["a", 0] != got["c", 0] and got["a", 4] == got["c", 4]
    assert got["a", 0][1] == 5 and got["d", 0][1] == 8 and len(got) == len(rows)
    assert canonical.tree_digests(elements(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("raw,want", [
    ("RebeccaPurple", "#663399"), (" 'red' ", "#ff0000"), ("#ABC", "#aabbcc"), ("#abc0", None), ("#abcd", "#aabbcc"), ("#12345", None), ("#11223300", None), ("#112233ff", "#112233"), ("rgb(50%, 0%, 100%)", "#8000ff"), ("rgba(1 2 3 / 0)", None), ("rgb(1,2)", "#rgb(1,2)"), ("rgb(300,-4,2.5)", "#ff0002"),
    ("hsl(120, 100%, 25%)", "#008000"), ("hsl(-120deg 100% 50%)", "#0000ff"), ("hsl(0,0%,50%)", "#808080"), ("hsla(0,100%,50%,0%)", None), ("hsl(x,1%,1%)", "#hsl(x,1%,1%)"), ("var(--x)", None), ("url(#a)", None), ("context-fill", None), ("inherit", None), ("", None), ("teall", "teall"), (None, None),
])
def test_colours(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "c string").select(colour.parse(F.col("c"))).first()[0] == want
