"""Documents settled whole against the rounds, and what is read of texts against the expressions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrymill import scratch
from quarrymill.operators import cascade, scopes, whole
from quarrymill.plans import catalogue, drawings
from tests.test_catalogue import DATA

SCHEMA = "doc_id long, node_id long, parent_id long, tag string, attrs map<string,string>, text string"
KINDS = ["g", "PATH", "rect", "defs", "clipPath", "linearGradient", "stop", "use", "symbol", "tspan", None]
SHEETS = [
    ".a{fill:red} g .a{stroke:blue !important} #i4{fill:inherit;opacity:0} @media screen{g{fill:tan}} @media PRINT{path,stop{stop-color:lime}}",
    "/* x{} */ g g rect, .b .a path { stroke: currentColor; stroke-width: 2pt } rect > path{fill:gold} *{fill:pink} .a.b{visibility:visible} g a:hover{fill:teal}",
    ".a{fill:one} .a{fill:two; FILL : three !important} rect{fill:tag} } { .b{fill:lost} } .b{stroke:kept}", "g", None,
]


def documents(rng, docs, most=30):
    rows = []
    for doc in range(docs):
        rows.append((doc, 0, None, "svg", {"color": "teal"}, None))
        path = [0]
        for node in range(1, rng.randrange(2, most)):
            if doc % 5:
                del path[rng.randrange(1, len(path) + 1) :]
            attrs = {"id": rng.choice([f"i{node}", "i1", None])}
            put = lambda name, share, values: attrs.update({name: rng.choice(values)}) if rng.random() < share else None  # noqa: B023, E731
            put("class", 0.6, ["a", " B  a", "c", "\ta"])
            put("fill", 0.4, ["red", "Inherit", "none", f"url( '#i{rng.randrange(most)}' )", " initial", "URL(#i2) url(#i3)", "url(#i5"])
            put("style", 0.4, ["display:none", "display: none;", "opacity:0", "opacity: 0%", "opacity:-1d", "visibility:hidden", "visibility: visible", "stroke:blue", "fill: lime !important; fill:x", "opacity:.5", "stroke : unset; stop-color:tan", ":;x", ""])
            put("stroke-opacity", 0.2, ["0.5", "1", "x"])
            put("transform", 0.1, ["Scale(2)", "none"])
            put("href", 0.3, [f"#i{rng.randrange(most)}", "#", " #i2 ", "x"])
            sheet = rng.random() < 0.15
            rows.append((doc, node, path[-1] if node % 17 else 99, "Style" if sheet else rng.choice(KINDS), attrs, rng.choice(SHEETS) if sheet else "x"))
            path.append(node)
    rows += [(None, 0, None, "g", {"fill": "red"}, None), (None, 5, None, "style", {}, SHEETS[0]), (None, 6, 0, "path", {"class": "a"}, None)]
    rng.shuffle(rows)
    return rows


WAYS = [("fill", "stroke", "stroke_width", "fill_opacity", "stroke_opacity", "color"), ("stop-color", "opacity", "filter")]


@pytest.mark.parametrize("most,batch", [(1000, 10000), (1000, 7), (12, 7)])
def test_whole_documents_agree_with_the_rounds(spark, most, batch):
    elements = spark.createDataFrame(documents(random.Random(most + batch), 60), SCHEMA)
    passed, own = WAYS
    columns = ["doc_id", "node_id", "tag", *passed, "scaled", "scope"]
    value = lambda p: F.try_element_at("style", F.lit(p))["value"]
    want = scopes.resolved(elements).select(*columns, *(value(p).alias(f"own_{p}") for p in own))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = scopes.drawn(elements, passed, own, most=most)
        some = scopes.drawn(elements, ("stroke",), kept=("painted",), most=most).select("doc_id", "node_id", "stroke")
        same = lambda a, b: sorted(map(tuple, a.collect()), key=key_of) == sorted(map(tuple, b.collect()), key=key_of)
        key_of = lambda r: tuple(str(x) for x in r)
        assert set(got.columns) == set(want.columns)
        assert same(got.select(*want.columns), want) and len({r.scope for r in want.collect()}) == 5
        assert same(some, want.where("scope = 'painted'").select("doc_id", "node_id", "stroke"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert scopes.drawn(elements.limit(0), *WAYS).count() == 0


def test_sheets_read_as_by_the_expressions(spark):
    rng = random.Random(3)
    bits = ["{", "}", "}", "{", "g .a", "g,.b , #c", "@media print", "@media (x) ALL", "@media screen", "@font-face", "fill:red", ";", " Stroke :\n a  b ! Important ", "/*", "*/", "@import x;", "@CHARSET", "color:x:y;color:", "é", "\x0b", ":", "!important"]
    sheets = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)] + [s for s in SHEETS if s]
    found = cascade.style_rules(spark.createDataFrame(list(enumerate(sheets)), "doc_id long, text string").withColumn("node_id", F.lit(1)))
    want = {(r.doc_id, r.rule.at, r.rule.turn, r.selector, r.prop, r.value, r.important) for r in found.collect()}
    got = {(k, at, turn, selector, p, *v) for k, s in enumerate(sheets) for at, turn, selector, block in whole.style_rules(s) for p, v in block.items()}
    assert got == want and len({k for k, *_ in got}) > 40
    names = ["g", ".a", "#X", "a.b.a", "g  .a", "*", "a[x]", "a:b", "g>h", "g ~ h", "a#b#c.D", "g *", "", "é", " \x0bg", "-x _y"]
    steps = cascade.selector_steps(spark.createDataFrame(list(enumerate(names)), "rule long, selector string").withColumn("doc_id", F.lit(1)))
    want = {(r.rule, r.step, r.tag, r.id, tuple(r.classes)) for r in steps.collect()}
    assert {(k, i, *step) for k, n in enumerate(names) for i, step in enumerate(whole.selector_steps(n) or [])} == want


def test_opacities_read_as_by_the_cast(spark):
    raw = ["0", "0%", " 0.0 ", "-1", "1", "0d", "0F%", "1e-400", "-1e999", "1e999", "nan", "-Inf", "-infinity%", "+inf", "0x0p1", "0x1p3", "-0x1p99999", "0x1", "", "%", "x", "1_0", ".", "0.", ".0", "+0", "0 %", "٠", "0\t", "0%%", "- 1"]
    seen = spark.createDataFrame([(r,) for r in raw], "c string").select("c", scopes.visible(F.col("c")).alias("v")).collect()
    assert {r.c for r in seen if r.v == whole.clear(r.c)} == set()


def test_tables_hold_whole_documents():
    docs = [0] * 3 + [1] * 40 + [2] + [None] * 3 + [3] * 5
    table = pa.table({"doc_id": pa.array(docs, pa.int64()), "at": pa.array(range(len(docs)))})
    for size in (1, 2, 7, 100):
        whole_rows = [t["at"].to_pylist() for t in whole.whole_documents(table.to_batches(max_chunksize=size), 1000)]
        assert sum(whole_rows, []) == list(range(len(docs)))
        held = [x for t in whole.whole_documents(table.to_batches(max_chunksize=size), 10) for x in t["at"].to_pylist()]
        assert set(range(len(docs))) - set(held) <= set(range(14, 43)) and (size == 100 or len(held) < 40)
    few = whole.ROWS
    try:
        whole.ROWS = 4
        cuts = [t["at"].to_pylist() for t in whole.whole_documents(table.to_batches(max_chunksize=2), 1000)]
    finally:
        whole.ROWS = few
    assert len(cuts) > 3 and sum(cuts, []) == list(range(len(docs))) and all(c[0] in np.cumsum([0, 3, 40, 1, 1, 1, 1]) for c in cuts)


@pytest.mark.parametrize("name", ["nested_notes", "nested_color_count", "nested_paint_scopes", "nested_stroke_widths"])
def test_small_drawings_take_no_rounds(spark, monkeypatch, name):
    seen, write = [], scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, label: (seen.append((label, df._jdf.queryExecution().executedPlan().toString())), write(df, label))[1])
    monkeypatch.setattr(cascade, "written", scratch.written)
    monkeypatch.setattr(scopes, "written", scratch.written)
    catalogue.QUERIES[name](spark, DATA)
    assert [label for label, _ in seen] == ["drawn"] and seen[0][1].count("Exchange") == 1


def test_plain_drawings_are_the_drawings(spark):
    plain = drawings.plain_view(spark, DATA)
    named = [c for c in plain.columns if c.startswith("@")]
    entries = F.array_compact(F.array(*(F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(c[1:]).alias("key"), F.col(f"`{c}`").alias("value"))) for c in named)))
    got = plain.select("doc_id", "node_id", "parent_id", "tag", "text", F.map_from_entries(entries).alias("attrs"))
    want = drawings.nested_view(spark, DATA).select(*got.columns)
    rows = lambda df: sorted(repr([*r[:5], sorted(r.attrs.items())]) for r in df.collect())
    assert rows(got) == rows(want)
