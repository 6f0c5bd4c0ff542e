"""The joins on word runs against brute force: large groups, periodic texts, hostile words, odd rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quarrymill.llm import hashing, repeats, shingle_join

SCHEMA = "doc_id long, text string, key string, node string, rid long, grams string, whole string"


def table(spark, items):
    return spark.createDataFrame([(d, t, "k", "n", 1, "g", "w") for d, t in items], SCHEMA).repartition(3)


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n)), "".join("ba"[i.bit_count() % 2] for i in range(n))


def components(items):
    sets = []
    for _, t in items:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    label = list(range(len(items)))
    for i, (d, _) in enumerate(items):
        for j in range(i):
            s, t = sets[i], sets[j]
            if d is not None and items[j][0] is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    least = {}
    for (d, _), c in zip(items, label, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return sorted(((d, len(s), None if d is None else least[c]) for (d, _), s, c in zip(items, sets, label, strict=True)), key=str)


def removed(items):
    first, out = {}, []
    words = [(d, (t or "").encode().split()) for d, t in items]
    for d, w in words:
        for i in range(len(w) - 49):
            if d is not None:
                k = tuple(w[i : i + 50])
                first[k] = min(d, first.get(k, d))
    for d, w in words:
        gone = set()
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def joined(spark, items):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in shingle_join.similar_components(table(spark, items)).collect()), key=str)


def cut(spark, items):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(table(spark, items)).collect()), key=str)


def test_words_that_cancel_out_in_sums_are_told_apart(spark):
    one, two = thue_morse(2048)
    text = [f"w{i}" for i in range(60)]
    items = [(1, one), (2, two), (3, " ".join([*text[:30], one, *text[30:]])), (4, " ".join([*text[:30], two, *text[30:]]))]
    assert joined(spark, items) == components(items) and {c for *_, c in components(items)} == {1, 2, 3}
    assert cut(spark, items) == removed(items) and all(n == 0 for _, _, n, _ in removed(items))


def test_word_hashes_follow_the_bytes():
    words = [b"a", b"a\0", b"\0a", b"A", b"x" * 15, b"x" * 16, b"x" * 15 + b"\0", b"x" * 17, "é".encode(), b"a\x85b", b"a\x1cb"]
    texts = pa.array([b" ".join(words), None, b"", b"\t\n " + b"\x0b".join(reversed(words)) + b"\r"], pa.binary())
    lanes, cuts = hashing.word_hashes(texts)
    assert cuts.tolist() == [0, 11, 11, 11, 22]
    assert len({tuple(x) for x in lanes.T.tolist()}) == 11 and lanes[:, :11].tolist() == lanes[:, 11:][:, ::-1].tolist()
    numbers, _ = hashing.word_numbers(texts, lower=True)
    assert numbers[0] == numbers[3] and len(set(numbers.tolist())) == 10 and (numbers[:11] == numbers[11:][::-1]).all()


def test_runs_of_words_depend_on_their_order():
    words = np.arange(1, 400, dtype=np.uint64)
    for width in (1, 2, 5, 8, 50):
        runs = hashing.run_hashes(words, width)
        assert runs.size == 400 - width and np.unique(runs).size == runs.size
        assert hashing.run_hashes(words[7 : 7 + width], width)[0] == runs[7]
        if width > 1:
            assert hashing.run_hashes(words[7 : 7 + width][::-1], width)[0] != runs[7]


def near_copies(rng, n, size, most, words=100):
    base = [f"w{rng.randint(0, words)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(size)] = f"v{rng.randint(0, 9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed,size,most", [(1, 60, 6), (2, 140, 9)])
def test_components_of_a_large_group_on_the_brink(spark, seed, size, most):
    """Near copies just above and below the threshold: the stars fail, and sets lack credits."""
    rng = random.Random(seed)
    items = list(enumerate(near_copies(rng, 260, size, most)))
    rng.shuffle(items)
    assert joined(spark, items) == components(items)


def test_blocks_and_rounds_of_a_large_group(spark, monkeypatch):
    """Also where a group is dealt in blocks, and each round asks for one partner only (the
    functions are local, so the settings reach the workers)."""
    rng = random.Random(8)
    items = list(enumerate(near_copies(rng, 90, 60, 6)))
    monkeypatch.setattr(shingle_join, "BLOCK", 16)
    monkeypatch.setattr(shingle_join, "ASK_ROUND", 1)
    assert joined(spark, items) == components(items)


def test_rounds_are_for_sets_with_partners_left(spark, monkeypatch):
    """A set that has asked in full asks no more, and its keys are not read again."""
    rows, ask = [], shingle_join.partners
    monkeypatch.setattr(shingle_join, "partners", lambda index, *rest: (rows.append(index.count()), ask(index, *rest))[1])
    items = list(enumerate(near_copies(random.Random(1), 260, 60, 6)))
    assert joined(spark, items) == components(items)
    assert rows and all(n < m for m, n in zip(rows, rows[1:], strict=False))
    rows.clear()
    items = items[:40]
    assert joined(spark, items) == components(items) and len(rows) == 1


def test_least_forest():
    rng = np.random.default_rng(9)
    for n in (2, 3, 10, 60):
        for edges in (0, 1, n, 4 * n):
            u, v = rng.integers(0, n, (2, edges))
            root, want = list(range(n)), []
            for k, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
                if root[a] != root[b]:
                    want.append(k)
                    root = [root[a] if r == root[b] else r for r in root]
            assert shingle_join.least_forest(u, v, n).tolist() == want


def group_rows(n, key=1, apart=1):
    """A group of n sets, each a component of its own, with one of 16 sketches."""
    rows = []
    for i in range(n):
        sketch = np.zeros(shingle_join.SKETCH_WORDS, dtype=np.uint64)
        sketch[i % 16] = apart
        rows.append({"key": key, "bx": 0, "by": 0, "node": i.to_bytes(2), "component": i.to_bytes(2), "deleted": False, "probe": 2, "size": 100, "role": 3, "refuted": None, "sketch": sketch.tobytes()})
    return rows


def test_a_group_passes_on_no_more_pairs_than_rows():
    types = pa.schema([("key", pa.int64()), ("bx", pa.int32()), ("by", pa.int32()), ("node", pa.binary()), ("component", pa.binary()), ("deleted", pa.bool_()), ("probe", pa.int32()), ("size", pa.int64()), ("role", pa.int32()), ("refuted", pa.list_(pa.binary())), ("sketch", pa.binary())])
    rows = group_rows(300) + group_rows(3, key=2) + group_rows(40, key=3, apart=(1 << 40) - 1)
    rows[250]["refuted"] = [i.to_bytes(2) for i in range(250)]
    found = pa.Table.from_batches(shingle_join.spanning(iter([pa.RecordBatch.from_pylist(rows, schema=types)]))).to_pylist()
    large, small, torn = ([(r["x"], r["y"], r["whole"]) for r in found if r["key"] == k] for k in (1, 2, 3))
    assert len(large) == 299 and not any(whole for *_, whole in large) and all(x > y for x, y, _ in large)
    reached = {(0).to_bytes(2)}
    for _ in range(300):
        reached |= {z for x, y, _ in large if x in reached or y in reached for z in (x, y)}
    assert len(reached) == 300
    assert [x for x, _, _ in large].count((250).to_bytes(2)) == 0  # refuted with all smaller sets
    assert sorted(small) == [(b"\0\1", b"\0\0", True), (b"\0\2", b"\0\0", True), (b"\0\2", b"\0\1", True)]
    assert len(torn) == 32 and all(whole and int.from_bytes(x) % 16 == int.from_bytes(y) % 16 for x, y, whole in torn)


def test_groups_that_a_forest_joins_are_settled(spark, monkeypatch):
    """The pairs of near copies that one forest shows to be one component are not asked for."""
    rows, ask = [], shingle_join.partners
    monkeypatch.setattr(shingle_join, "partners", lambda index, *rest: (rows.append(index.count()), ask(index, *rest))[1])
    items = list(enumerate(near_copies(random.Random(1), 260, 60, 6)))
    assert joined(spark, items) == components(items) and rows == [0]


def test_asking_alone_gives_the_same(spark, monkeypatch):
    """Where a forest shows nothing, all its groups are left to the asking sets."""
    rows, ask, forests = [], shingle_join.partners, shingle_join.forests
    monkeypatch.setattr(shingle_join, "forests", lambda *given: forests(*given).where("false"))
    monkeypatch.setattr(shingle_join, "unsettled", lambda index, *rest: index)
    monkeypatch.setattr(shingle_join, "partners", lambda index, *rest: (rows.append(index.count()), ask(index, *rest))[1])
    items = list(enumerate(near_copies(random.Random(1), 260, 60, 6)))
    assert joined(spark, items) == components(items) and rows[0] > 0


def test_index_keeps_what_can_meet(spark):
    node = lambda i: bytes([i])
    every = [
        (1, 1, False, 1), (1, 2, False, 0), (1, 3, True, 0),  # whole agreement: nothing for a row without a shingle
        (2, 1, False, 2), (2, 2, False, 0), (2, 3, True, 0),
        (3, 1, True, 2), (3, 2, True, 2),  # none whole
        (4, 1, True, 2), (4, 2, False, 0), (4, 3, True, 0),
        (5, 1, False, 2), (5, 1, True, 2), (6, 2, False, 0), (6, 3, False, 0),
    ]
    df = spark.createDataFrame([(k, node(n), d, p) for k, n, d, p in every], "key long, node binary, deleted boolean, probe int")
    as_rows = lambda df: sorted((r.key, r.node[0], r.deleted, r.probe) for r in df.collect())
    index = shingle_join.served(df)
    assert as_rows(index) == sorted(r for r in every if r[0] in (1, 2, 4) and r[:2] not in ((1, 3), (4, 3)))
    still = spark.createDataFrame([(node(2),), (node(9),)], "node binary")
    assert as_rows(shingle_join.narrowed(index, still)) == []
    asks = index.unionByName(spark.createDataFrame([(1, node(2), False, 2)], df.schema)).where("key < 4")
    assert as_rows(shingle_join.narrowed(asks, still)) == [(1, 1, False, 0), (1, 2, False, 0), (1, 2, False, 2)]


def test_join_of_odd_rows(spark):
    body = " ".join(f"w{i}" for i in range(40))
    items = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (5, body), (6, body + " x"), (7, body + " x"), (6, "other words here"), (None, body), (9, body.upper()), (8, "ONE two É"), (10, "one two é")]
    assert joined(spark, items) == components(items)


def test_allocation_gives_the_credits_that_lack():
    rng = random.Random(2)
    for _ in range(200):
        dear = [(rng.randint(9, 500), s) for s in range(rng.randint(0, 30))]
        wide = {s for _, s in dear if rng.random() < 0.7}
        lack = rng.randint(1, 12)
        whole, near = shingle_join.allocate(lack, dear, wide)
        assert set(near) <= wide and not set(whole) & set(near)
        assert len(whole) + 2 * len(near) >= lack or len(whole) + len(near) == len(dear)


def test_neighbourhoods_meet_sets_one_shingle_apart():
    rng = np.random.default_rng(3)
    for n in (8, 40, 200):
        a = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
        b = np.delete(a, n // 2)
        band = shingle_join.band_of(a.size)
        full_a, less_a, _ = shingle_join.neighbourhood(a, band)
        full_b, less_b, _ = shingle_join.neighbourhood(b, band)
        same = np.intersect1d(full_a, full_b).size
        assert same >= full_b.size - 1 and (same == full_b.size or np.intersect1d(less_a, full_b).size == full_b.size - same)
        assert (full_a == shingle_join.signatures(a, band)).all()


@pytest.mark.parametrize("size", [None, 0, 4000])
def test_passages_periodic_and_hot(spark, monkeypatch, size):
    """A passage in most documents, texts of two words in turn, copies: groups are split, too."""
    if size is not None:  # groups by bytes: every group is large, or some are, or none
        monkeypatch.setattr(repeats, "GROUP_BYTES", size)
        monkeypatch.setattr(repeats, "SOLVED_BYTES", 300)
    monkeypatch.setattr(repeats, "PIECE", 40)
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    passage = words(75)
    items = [(d, " ".join([*words(rng.randint(0, 60)), *passage[rng.randint(0, 9) :], *words(rng.randint(0, 60))])) for d in range(40)]
    items += [(50, " ".join(["a", "b"] * 120)), (41, " ".join(["b", "a"] * 90)), (60, "x " * 300), (61, "x\n" * 200)]
    items += [(70, items[3][1]), (70, items[4][1]), (2, items[5][1]), (None, items[6][1]), (80, None), (81, ""), (82, " ".join(passage[:49])), (83, " ".join(passage[:50]))]
    rng.shuffle(items)
    assert cut(spark, items) == removed(items)
    assert cut(spark, items[:0]) == []


def test_suffix_trees_show_every_repeat():
    """Against all windows of all pieces: small alphabets, periodic pieces, one document in many pieces."""
    from quarrymill.llm.suffix_tree import SuffixTree, repeated_runs

    for seed in range(250):
        rng = random.Random(seed)
        width, words = rng.choice([1, 2, 3, 5]), [bytes([97 + i]) for i in range(rng.choice([1, 2, 3, 6]))]
        pieces = [[rng.choice(words) for _ in range(rng.randrange(25))] for _ in range(rng.randrange(1, 9))]
        if seed % 2 and len(pieces) > 2:
            pieces[1] = pieces[0][2:] + pieces[0]
        docs = [rng.randrange(6) for _ in pieces]
        least = {}
        for piece, doc in zip(pieces, docs):
            for i in range(len(piece) - width + 1):
                key = tuple(piece[i : i + width])
                least[key] = min(least.get(key, doc), doc)
        want = {(k, i) for k, (piece, doc) in enumerate(zip(pieces, docs)) for i in range(len(piece) - width + 1) if least[tuple(piece[i : i + width])] < doc}
        runs = repeated_runs(pieces, docs, width)
        assert {(k, s + i) for k, s, n in runs for i in range(n)} == want and sum(n for *_, n in runs) == len(want)
        tree = SuffixTree(pieces, docs, width)
        up = tree.parent >= 0
        assert (tree.depth >= width).all() and (tree.depth[tree.parent[up]] < tree.depth[up]).all() and (tree.least[tree.parent[up]] <= tree.least[up]).all()


def test_long_words_do_not_make_a_group_heavy(spark):
    words = ["x" * 3000 + str(i) for i in range(80)]
    items = [(k, " ".join(words[k % 3 :])) for k in range(12)]
    assert cut(spark, items) == removed(items)
