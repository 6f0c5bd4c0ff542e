"""Work in rounds and blocks against plain loops: greedy groups, blobs, blends, carried sums, sessions, streams."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from quarrymill.operators import greedy, learning, pixels, plates, relations
from quarrymill.scratch import folder
from quarrymill.streaming import counters

T0 = dt.datetime(2024, 1, 1)


def test_first_leaders_equal_the_sequential_rule(spark):
    rng = random.Random(2)
    items, links, want = [], [], {}
    for block, n, density in (("chain", 40, None), ("dense", 30, 0.3), ("loose", 60, 0.03), ("one", 1, 0)):
        own = [(k, k - 1) for k in range(1, n)] if density is None else [(k, e) for k in range(n) for e in range(k) if rng.random() < density]
        items += [(block, k) for k in range(n)]
        links += [(block, *x) for x in own]
        leaders = []
        for k in range(n):
            led = [e for e in leaders if (k, e) in own]
            want[block, k] = led[0] if led else k
            leaders += [] if led else [k]
    frames = spark.createDataFrame(items, "block string, place long"), spark.createDataFrame(links + links[:5], "block string, place long, earlier long")
    for bucket in (1, 8, 1000):
        got = greedy.first_leaders(*frames, bucket=bucket).collect()
        assert {(r.block, r.place): r.leader for r in got} == want and len(got) == len(items)
    assert greedy.first_leaders(frames[0].limit(0), frames[1]).count() == 0


def test_blobs_equal_a_flood_fill(spark):
    rng = random.Random(3)
    marks = {(i, y, x) for i in range(3) for y in range(14) for x in range(30) if rng.random() < (0.3, 0.55, 0.8)[i]} | {(3, 5, 7)}
    want, left = {}, set(marks)
    while left:
        todo = [left.pop()]
        size, image = 0, todo[0][0]
        while todo:
            i, y, x = todo.pop()
            size += 1
            for near in ((i, y - 1, x), (i, y + 1, x), (i, y, x - 1), (i, y, x + 1)):
                if near in left:
                    left.remove(near)
                    todo.append(near)
        want.setdefault(image, []).append(size)
    frame = spark.createDataFrame([*marks, (3, 5, 7)], "image long, y long, x long")
    for block in (4, 256):
        got = Counter((r.image, r.pixels) for r in pixels.blobs(frame, "image", block).collect())
        assert got == Counter((i, n) for i, sizes in want.items() for n in sizes)
    assert {(r.image, r.largest, r.blobs) for r in pixels.blob_sizes(frame, "image").collect()} == {(i, max(s), len(s)) for i, s in want.items()}
    assert pixels.blob_sizes(frame.limit(0), "image").count() == 0


def test_blends_go_to_their_inks(spark):
    inks = [("i", 0, 200, 0, 0, 60.0, 1), ("i", 1, 0, 0, 200, 30.0, 1), ("i", 2, 100, 0, 100, 3.0, 1), ("i", 3, 228, 128, 128, 2.0, 1), ("i", 4, 50, 0, 150, 4.0, 1), ("i", 5, 101, 3, 99, 6.0, 1), ("i", 6, 0, 250, 0, 1.0, 1)]
    clusters = spark.createDataFrame(inks, "image string, cluster long, r long, g long, b long, share double, members long")
    segments = {r.cluster: (r.one, r.two) for r in plates.blend_segments(clusters, "image").collect()}
    assert segments[2] == (0, 1) and segments[3] == (0, plates.PAPER) and 0 not in segments and 6 not in segments
    solid = spark.createDataFrame([("i", 4, True)], "image string, cluster long, has_interior boolean")
    got = {r.cluster: (round(r.share, 3), r.absorbed, r.kept) for r in plates.absorb_blends(clusters, plates.blend_segments(clusters, "image"), solid, "image").collect()}
    assert got[0] == (65.0, 2, True) and got[2][2] is False and got[3][2] is False  # the blend into the larger ink, the one with paper into its ink
    assert got[4] == (4.0, 0, True) and got[5] == (6.0, 0, True) and got[6] == (1.0, 0, True)  # inside, too large, on no line


def test_tone_has_two_arms(spark):
    ramp = [("ramp", y, x, 90 + 2 * (y // 3), 90, 90) for y in range(24) for x in range(20)]
    photo = [("photo", y, x, (7 * y) % 256, (11 * x) % 256, (y * x) % 256) for y in range(20) for x in range(20)] + [("photo", y, x, 1, 2, 3) for y in range(20, 40) for x in range(20)]
    flat = [("flat", y, x, 10, 10, 10) if x < 9 else ("flat", y, x, 255, 255, 255) for y in range(20) for x in range(20)]
    view = spark.createDataFrame(ramp + photo + flat, "image string, y long, x long, r long, g long, b long")
    got = {r.image: r for r in plates.tone(view, plates.plates(view, "image", 1.0), "image", 1.0, 6, 3.0, 100).collect()}
    assert (got["ramp"].arm, got["ramp"].ramp_members, got["photo"].arm, got["flat"].arm, got["flat"].screens) == ("ramp", 8, "diffuse", None, 1)


def test_components_and_running_sums(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 1), (20, 21), *((100 + k, 101 + k) for k in range(30))]
    got = {r.node: r.component for r in relations.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert [got[n] for n in (1, 2, 3, 7, 8, 9, 21)] == [1, 1, 1, 7, 7, 7, 20] and {got[100 + k] for k in range(31)} == {100}
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.8 else "cold", rng.randrange(-40, 90), rng.choice([None, 1, 5, -2])) for _ in range(150)]
    frame = spark.createDataFrame(rows, "k string, at long, v long")
    for f, plain in ((F.sum, sum), (F.max, max), (F.min, min)):
        for r in relations.running(frame, ["k"], "at", "v", f, 10).collect():
            before = [v for k, at, v in rows if k == r.k and at < r["at"] and v is not None]
            assert r._v == (plain(before) if before else None)


def test_as_of_and_sessions_of_one_hot_key(spark):
    rng = random.Random(6)
    at = lambda: T0 + dt.timedelta(minutes=rng.randrange(0, 9000))
    key = lambda: rng.choice(["hot", "hot", "hot", "cold", None])
    left, right = [(i, key(), at()) for i in range(120)], [(key(), at(), rng.choice([None, "a", "b", "c"])) for _ in range(60)]
    a, b = spark.createDataFrame(left, "id long, k string, t timestamp"), spark.createDataFrame(right, "k string, t timestamp, v string")
    for r in relations.as_of(a, b, "k", "t", "t", "v", hours=6).collect():
        known = [(t, v) for k, t, v in right if k == r.k and t <= r.t and v is not None]
        last = {v for t, v in known if t == max(t for t, _ in known)} if known else {None}
        assert r.v in last
    sessions = Counter()
    for k in {k for _, k, _ in left if k}:
        number, before = 0, None
        for t in sorted(t for _, own, t in left if own == k):
            number += before is None or (t - before).total_seconds() >= 1800
            before = t
            sessions[k, number] += 1
    got = relations.gap_sessions(a.where("k IS NOT NULL"), "k", "t", 1800, hours=6).collect()
    assert {(r.k, r.session): r.n for r in got} == dict(sessions)


def test_a_later_line_without_a_place_keeps_the_place(spark):
    lines = [("t1", "j", "s", "shown", 3), ("t2", "j", "s", "shown", None), ("t1", "j", "u", "star", None), ("t0", "j", "u", "star", 5), ("t9", "j", "w", "shown", None)]
    log = spark.createDataFrame(lines, "t string, job string, svg_sha string, event string, pos int")
    want = {"s": 3, "u": 5, "w": None}
    assert {r.svg_sha: r.pos for r in learning.fold_events(log).collect()} == want
    parts = counters.fold_parts(log.where("t < 't2'")).unionByName(counters.fold_parts(log.where("t >= 't2'")))
    merged, whole = counters.merged_fold(parts), learning.fold_events(log)
    assert {r.svg_sha: r.pos for r in merged.collect()} == want and sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.select(*merged.columns).collect()))


def test_counters_expire_and_survive_a_restart(spark):
    path, store, checkpoint = (folder(spark, n) for n in ("in", "store", "checkpoint"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", counters.PROVIDER)
    try:
        def feed(rows):
            spark.createDataFrame(rows, "bucket string, at timestamp, success boolean").coalesce(1).write.mode("append").parquet(path)
            stream = spark.readStream.schema("bucket string, at timestamp, success boolean").parquet(path)
            counters.store_batches(counters.expiring_counters(stream, 3600, "1 minute"), store, checkpoint)
            return {r.bucket: (r.attempts, r.successes, r.starts) for r in counters.latest_counters(spark, store).collect()}

        at = lambda m: T0 + dt.timedelta(minutes=m)
        assert feed([("a", at(0), True), ("a", at(30), False), ("b", at(5), True)]) == {"a": (2, 1, 1), "b": (1, 1, 1)}
        # from the checkpoint: a goes on, b was quiet for too long and starts anew
        assert feed([("a", at(80), True), ("b", at(70), None), ("b", at(75), True)]) == {"a": (3, 2, 1), "b": (2, 1, 2)}
        # time moves on with c alone: the timers of a and b fire
        feed([("c", at(400), True)])
        rows = spark.read.schema(counters.COUNTERS + ", batch long").parquet(store)
        assert {r.bucket for r in rows.where("expired").collect()} == {"a", "b"}
        assert feed([("a", at(401), True)])["a"] == (1, 1, 2)
        # a batch that runs again replaces its folder
        before = rows.count()
        last = spark.read.schema(counters.COUNTERS).parquet(f"{store}/batch=0")
        last.write.mode("overwrite").parquet(f"{store}-again/batch=0")
        assert spark.read.parquet(f"{store}-again").count() == last.count() and before >= 5
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_replayed_batch_counts_once(spark):
    path, store = folder(spark, "log"), folder(spark, "folds")
    kind = "t string, job string, svg_sha string, event string, pos int"
    spark.createDataFrame([("t1", "j", "s", "shown", 1), ("t2", "j", "s", "star", 1)], kind).coalesce(1).write.parquet(path)
    read = lambda: {(r.svg_sha, r.shown, r.action) for r in counters.merged_fold(spark.read.parquet(store).drop("batch")).collect()}
    counters.store_folds(spark.readStream.schema(kind).parquet(path), store, folder(spark, "one"))
    assert read() == {("s", True, 1)} and spark.read.parquet(store).count() == 1
    # another checkpoint replays batch 0 into the same store
    counters.store_folds(spark.readStream.schema(kind).parquet(path), store, folder(spark, "two"))
    assert read() == {("s", True, 1)} and spark.read.parquet(store).count() == 1
