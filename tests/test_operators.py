import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import learning, pixels, relations
from quarrymill.plans import events as event_plans
from quarrymill.plans import pixels as pixel_plans
from quarrymill.sources import readers
from quarrymill.streaming import exposure


def events(spark):
    rows = [
        ("2024-01-01T00:00:00", job, f"s{i}", kind, i, None)
        for job in ("j1", "j2")
        for i, kind in ((1, "shown"), (2, "shown"), (3, "shown"), (2, "star"))
    ]
    return spark.createDataFrame(rows, "t string, job string, svg_sha string, event string, pos int, ranker string")


def test_fold_does_not_depend_on_order(spark):
    log = events(spark)
    one = sorted(learning.fold_events(log).collect())
    two = sorted(learning.fold_events(log.orderBy(F.desc("pos"), "job").repartition(3)).collect())
    assert one == two and len(one) == 6
    assert learning.preference_pairs(learning.fold_events(log)).count() == 4


def test_stream_equals_batch(spark, tmp_path):
    lines = [json.dumps(r.asDict()) for r in events(spark).collect()] + ["[1, 2]", "junk", '{"t": "x", "job": "j1", "pos": true}']
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(lines))
    assert readers.read_json_lines(spark, str(tmp_path / "log")).count() == 9
    stream = exposure.exposure_fold(exposure.event_stream(spark, str(tmp_path / "log")))
    exposure.drain(stream, "folded", "complete", str(tmp_path / "cp"))
    batch = learning.fold_events(readers.read_json_lines(spark, str(tmp_path / "log")))
    assert sorted(map(str, spark.table("folded").collect())) == sorted(map(str, batch.collect()))


def test_clusters_blobs_and_as_of(spark):
    hist = spark.createDataFrame([("a", 0, 0, 0, 10), ("a", 10, 0, 0, 5), ("a", 25, 0, 0, 4)], "image string, r long, g long, b long, n long")
    assert sorted((r.r, r.n) for r in pixels.leader_clusters(hist, "image").collect()) == [(0, 15), (25, 4)]
    marks = spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("a", 1, 1), ("a", 5, 5)], "image string, y int, x int")
    assert pixels.blob_sizes(marks, "image").first()[1:] == (3, 2)
    left = spark.createDataFrame([(1, 5), (1, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 3, "v")], "k int, u int, v string")
    assert sorted(map(tuple, relations.as_of(left, right, "k", "t", "u", "v").collect()), key=str) == [(1, 1, None), (1, 5, "v")]


def test_inheritance_takes_the_nearest_ancestor(spark):
    rows = [("d", 0, None, {"fill": "red"}), ("d", 1, 0, {}), ("d", 2, 1, {"fill": "blue"}), ("d", 3, 2, {}), ("d", 4, 1, {})]
    df = spark.createDataFrame(rows, "doc_id string, node_id long, parent_id long, attrs map<string,string>")
    got = {r.node_id: r.fill for r in relations.nearest_ancestor(df, "fill").collect()}
    assert got == {0: "red", 1: "red", 2: "blue", 3: "blue", 4: "red"}


def test_ranker_learns_the_sign(spark):
    rows = [(f"j{j}/{i}", f"j{j}", float(i)) for j in range(5) for i in range(4)]
    df = spark.createDataFrame(rows, "key string, job string, colours double")
    pairs = spark.createDataFrame([(f"j{j}", f"j{j}/3", f"j{j}/{i}") for j in range(5) for i in range(3)], "job string, winner string, loser string")
    model = learning.fit_ranker(df, pairs, "key", ["colours"], iterations=5, cold_start_picks=2)
    assert model["weights"]["colours"] > 0
    assert learning.fit_ranker(df, pairs, "key", ["colours"])["kind"] == "cold"


DATA = os.environ.get("QUARRYMILL_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_ranker_query_takes_all_three_hundred_steps(spark):
    features = event_plans._features(spark, DATA).toPandas().set_index("key")[["level", "lines", "place"]]
    z = (features - features.mean()) / features.std(ddof=0)
    pairs = learning.preference_pairs(learning.fold_events(event_plans.event_log(spark, DATA))).toPandas()
    d = z.loc[pairs["job"] + "/" + pairs["winner"]].to_numpy() - z.loc[pairs["job"] + "/" + pairs["loser"]].to_numpy()
    weights = np.zeros(3)
    for _ in range(300):
        weights += 0.5 * ((d / (1 + np.exp(d @ weights))[:, None]).mean(axis=0) - 0.01 * weights)
    got = {r.feature: r.weight for r in event_plans.pairwise_ranker_fit(spark, DATA).collect()}
    assert [got[f] for f in features.columns] == pytest.approx(weights.tolist(), abs=1e-9)


def test_inks_go_by_their_share_of_the_image(spark):
    rows = [("small", 0, 8), ("small", 90, 2), ("large", 0, 19_980), ("large", 90, 11), ("large", 180, 9)]
    hist = spark.createDataFrame([(i, r, r, r, n) for i, r, n in rows], "image string, r long, g long, b long, n long")
    assert sorted((x.image, x.r) for x in pixel_plans.inks(hist).collect()) == [("large", 0), ("large", 90), ("small", 0), ("small", 90)]
