"""Plans and steps that grow with the tables: what may not be broadcast, repeated or cut."""

import os

from pyspark.sql import functions as F

from quarrymill import scratch
from quarrymill.operators import plates, prepress, relations, scopes, similarity


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blend_segments_broadcast_nothing(spark, tmp_path):
    rows = [(i, k, 60 * k, 255 - 50 * k, 90, 5) for i in range(3) for k in range(4)]
    spark.createDataFrame(rows, "image long, cluster long, r long, g long, b long, n long").write.parquet(f"{tmp_path}/inks")
    inks = spark.read.parquet(f"{tmp_path}/inks")
    assert "BroadcastExchange" not in _plan(plates.blend_segments(inks, "image"))
    near = plates.near_colours(inks.withColumnRenamed("cluster", "place"), "image", 20.0)
    assert "BroadcastExchange" not in _plan(near)


def test_absorb_blends_over_batches(spark):
    """Images that go on in the next batch are folded whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        clusters = spark.createDataFrame([(i, k, s) for i in range(9) for k, s in enumerate((50.0, 40.0, 3.0, 2.0 + i))], "image long, cluster long, share double")
        segments = spark.createDataFrame([(i, 2, 0, 1) for i in range(9)] + [(i, 3, -1, 1) for i in range(9)], "image long, cluster long, one long, two long")
        solid = spark.createDataFrame([(1, 2, True)], "image long, cluster long, has_interior boolean")
        got = {(r.image, r.cluster): (r.share, r.absorbed, r.kept) for r in plates.absorb_blends(clusters, segments, solid, "image").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i in range(9):
        small = 2.0 + i
        last = small <= plates.EDGE_PERCENT
        assert got[i, 0] == ((50.0, 0, True) if i == 1 else (53.0, 1, True))
        assert got[i, 1] == ((40.0 + small, 1, True) if last else (40.0, 0, True))
        assert got[i, 2] == (3.0, 0, i == 1)
        assert got[i, 3] == (small, 0, not last)


def test_climb_writes_wide_rows_once(spark, monkeypatch):
    from quarrymill import scratch

    seen, write = [], scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, label: (seen.append(df.columns), write(df, label))[1])
    rows = [(1, n, n - 1 if n else None, "x" * n, n if n == 2 else None) for n in range(9)] + [(None, 0, None, "y", 7)]
    nodes = spark.createDataFrame(rows, "doc_id long, node_id long, parent_id long, payload string, v long")
    found = relations.climb(nodes, {"v": F.coalesce("v", "_v")}, F.lit(True))
    assert found.columns == nodes.columns
    assert {(r.doc_id, r.node_id, r.payload, r.v) for r in found.collect()} == {(1, n, "x" * n, 2 if n >= 2 else None) for n in range(9)} | {(None, 0, "y", 7)}
    assert len(seen) > 3 and sum("payload" in columns for columns in seen) == 1


def test_resolved_leaves_only_what_it_reads(spark):
    sheet = "g .hot { fill: red } .hot { stroke: blue }"
    rows = [(1, 0, None, "svg", {}, None), (1, 1, 0, "style", {}, sheet), (1, 2, 0, "g", {}, None), (1, 3, 2, "path", {"class": "hot", "id": "a"}, None)]
    drawing = spark.createDataFrame(rows, "doc_id long, node_id long, parent_id long, tag string, attrs map<string,string>, text string")
    with scratch.collected() as tables:
        found = scopes.resolved(drawing)
    assert {(r.node_id, r.fill, r.stroke) for r in found.collect()} == {(0, None, None), (1, None, None), (2, None, None), (3, "red", "blue")}
    left = [t for t in tables if os.path.exists(t._written.removeprefix("file://"))]
    assert len(tables) > 6 and len(left) <= 4


def test_grams_are_counted_where_the_text_is(spark):
    docs = spark.createDataFrame([(1, "Abab"), (1, "ab!"), (None, "xyx"), (2, "q"), (3, ""), (4, None), (5, "\U0001f600á École")], "k long, text string")
    counts = similarity.gram_counts(docs, "k", "text")
    assert "Generate" not in _plan(counts)
    want = {(1, "ab", 3), (1, "ba", 1), (None, "xy", 1), (None, "yx", 1), (2, "q", 1)}
    got = {tuple(r) for r in counts.collect()}
    assert {r for r in got if r[0] != 5} == want
    three = {(r.gram, r.tf) for r in similarity.gram_counts(docs, "k", "text", 3).where("k = 1").collect()}
    assert three == {("aba", 1), ("bab", 1), ("ab", 1)}
    # rows without a key are weighed like others
    vectors = similarity.unit_vectors(counts, similarity.idf_table(counts, docs.selectExpr("count(*) AS docs")), "k")
    assert {round(r.w, 6) for r in vectors.where("k IS NULL").collect()} == {round(2**-0.5, 6)}


def test_hashes_of_a_label_meet_in_blocks(spark, monkeypatch):
    import random

    from quarrymill.plans import texts

    draw = random.Random(5)
    rows = [(i, i % 2 if i % 11 else None, [draw.random() < 0.5 for _ in range(9)] if i % 13 else [True, None] * 4 + [None]) for i in range(150)]
    rows += rows[5:9]  # a row that is there twice is in twice as many pairs, as in SQL
    monkeypatch.setattr(texts, "HASH_BLOCK", 20)
    monkeypatch.setattr(texts, "HASH_STEP", 7)
    hashes = spark.createDataFrame(rows, "vec_id long, label long, bits array<boolean>")
    found = texts.similar_hashes(hashes, 2)
    apart = lambda x, y: sum(p is not None and q is not None and p != q for p, q in zip(x, y, strict=True))
    want = sorted((a, b, apart(x, y)) for a, k, x in rows for b, m, y in rows if a < b and k is not None and k == m and apart(x, y) <= 2)
    assert sorted(map(tuple, found.collect())) == want


def test_narrow_drawings_agree_and_write_no_attributes(spark, monkeypatch):
    sheet = ".hot { fill: red; stroke: currentColor } svg { color: #00f }"
    rows = [
        (1, 0, None, "svg", {}, None), (1, 1, 0, "style", {}, sheet), (1, 2, 0, "defs", {"opacity": "0.5"}, None), (1, 3, 2, "linearGradient", {"id": "n"}, None), (1, 4, 3, "stop", {"stop-color": "lime"}, None),
        (1, 5, 0, "g", {"stroke-width": "2pt"}, None), (1, 6, 5, "path", {"class": "hot"}, None), (1, 7, 5, "rect", {"fill": "url(#n)", "style": "display:none"}, None), (1, 8, 2, "path", {}, None), (2, 0, None, "svg", {"fill": "tan", "x": None}, None), (2, 1, 0, "use", {}, None),
    ]
    drawing = spark.createDataFrame(rows, "doc_id long, node_id long, parent_id long, tag string, attrs map<string,string>, text string")
    wide = scopes.resolved(drawing)
    seen, write = [], scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, label: (seen.append((label, df.columns)), write(df, label))[1])
    same = lambda f, x: sorted(map(tuple, f(wide).collect())) == sorted(map(tuple, f(x).collect()))
    assert same(scopes.inks, scopes.resolved(drawing, **scopes.INKS)) and scopes.inks(wide).count() == 4
    assert same(scopes.strokes, scopes.resolved(drawing, **scopes.STROKES)) and scopes.strokes(wide).count() == 1
    assert same(lambda d: d.select("doc_id", "node_id", "scope"), scopes.resolved(drawing, **scopes.SCOPES))
    climbs = [c for label, c in seen if label == "climb"]
    assert len(climbs) > 3 and not any("attrs" in c or "text" in c for c in climbs)


def test_reports_meet_their_header_without_a_join(spark):
    head = "a b c d e f g h i j k l x-ppi"
    row = lambda ppi: f"1 2 image 40 50 c 3 8 e no 7 0 {ppi} {ppi}"
    rows = [(1, 0, head), (1, 1, "-- --"), (1, 2, row(90)), (1, 3, row(80)), (2, 0, "none"), (2, 2, row(70)), (3, 2, row(60)), (None, 0, head), (None, 2, row(50))]
    found = prepress.image_findings(spark.createDataFrame(rows, "doc_id long, n int, value string"))
    assert "Join" not in _plan(found)
    assert [tuple(r) for r in found.collect()] == [(1, 2, 40, 50, 80.0)]


def test_sheets_are_dealt_once(spark, tmp_path):
    from quarrymill.plans import sheets

    lines = spark.range(900).selectExpr("id div 3 AS l_orderkey", "cast(id % 3 AS int) AS l_linenumber", "id AS l_partkey", "id % 7 AS l_suppkey")
    lines.unionByName(lines.where("l_orderkey < 9")).write.parquet(f"{tmp_path}/lineitem.parquet")
    counts = sheets.sheet_view(spark, str(tmp_path)).groupBy("image", "r", "g", "b").count()
    assert _plan(counts).count("Exchange hashpartitioning") == 1 and counts.agg(F.sum("count")).first()[0] == 900


def test_small_images_cluster_in_one_pass(spark, monkeypatch):
    import random

    draw = random.Random(3)
    rows = sorted({(i, draw.randrange(0, 80), draw.randrange(0, 80), draw.randrange(0, 40)) for i in range(5) for _ in range(1 + 60 * i)})
    rows = [(*row, draw.randrange(1, 9)) for row in rows]
    want = []
    for image in range(5):
        led = []
        for _, *at, n in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[4], *r[1:4])):
            own = next((c for c in led if sum((a - b) ** 2 for a, b in zip(c[0], at, strict=True)) <= 400), None)
            if own is None:
                led.append([at, n, 1])
            else:
                own[1:] = own[1] + n, own[2] + 1
        want += [(image, k, *at, n, m) for k, (at, n, m) in enumerate(led)]
    colours = spark.createDataFrame(rows, "image long, r long, g long, b long, n long").repartition(3)
    clusters = lambda **how: sorted(map(tuple, plates.ink_clusters(colours, "image", **how).collect()))
    assert clusters(most=100) == want  # some images in one pass, some in rounds
    monkeypatch.setattr(plates, "first_leaders", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert clusters() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blobs_are_rounds_only_across_tiles(spark, monkeypatch):
    from quarrymill.operators import pixels

    seen, join = [], relations.components
    monkeypatch.setattr(relations, "components", lambda links: (seen.append(links.count()), join(links))[1])
    cross = [(1, y, x) for y in range(12) for x in range(12) if y == 5 or x == 7 or (y + x) % 5 == 0] + [(None, 0, 0), (None, 1, 0)]
    frame = spark.createDataFrame(cross + cross[:3], "image int, y int, x int")
    sizes = lambda block: sorted((r.image or 0, r.pixels) for r in pixels.blobs(frame, "image", block).collect())
    whole = sizes(16)
    assert not seen
    assert sizes(4) == whole == sizes(1) and len(seen) == 2 and 0 < seen[0] < seen[1]
