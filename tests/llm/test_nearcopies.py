import random
import time

import numpy as np

import corpus_pipeline as pipeline
from tapeloom.llm import nearcopies


def brute(rows):
    """The smallest id that links of Jaccard >= 0.8 over all pairs reach."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    return comp, links


def planted():
    """Documents with a passage that most share, and near copies at similarities around 0.8."""
    rnd = random.Random(4)
    vocab = [f"w{k}" for k in range(300)]
    common = [rnd.choice(vocab) for _ in range(40)]
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE two"), (5, "one two three four five"), (6, "one two three four five six")]
    for k in range(60):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(40, 200))]
        if k % 3:
            w[2:2] = common
        rows.append((100 + 10 * k, " ".join(w)))
        for c in range(1, rnd.randrange(2, 7)):
            v = list(w)
            for _ in range(rnd.randrange(1, 2 + len(w) // 50)):
                v[rnd.randrange(len(v))] = rnd.choice(vocab)
            if c == 3:
                v = v[len(v) // 9 :]
            rows.append((100 + 10 * k + c, " ".join(v)))
    rnd.shuffle(rows)
    return rows


def test_groups_match_brute_force(spark):
    rows = planted()
    want, links = brute(rows)
    assert len(links) > 40 and len({want[a] for a, _ in links}) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for tile, most in ((1024, 1 << 18), (8, 1 << 18), (8, 0)):
        assert {r.doc_id: r.component_id for r in nearcopies.groups(df, tile=tile, most=most).collect()} == want


def test_pipeline_stage_drops_every_near_copy(spark):
    rows = planted()
    want, _ = brute(rows)
    df = spark.createDataFrame([*rows, (None, "one two")], "doc_id long, text string")
    kept = pipeline.near_dedup(spark, df, "")
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*set(want.values()), None], key=str)


def test_test_table_has_near_copies_that_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.component_id for r in nearcopies.groups(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])[0] and got[56] == got[2]


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([("b", "a b c d"), ("b", "x y"), ("a", "A b c d"), ("b", "a b c d"), (None, "x y")], "doc_id string, text string")
    assert sorted(map(tuple, nearcopies.groups(df).collect())) == [("a", "a"), ("b", "a"), ("b", "a"), ("b", "b")]
    assert [(r.doc_id, r.text) for r in nearcopies.keep_first(df).orderBy("doc_id").collect()] == [(None, "x y"), ("a", "A b c d")]
    assert nearcopies.groups(df.limit(0)).count() == 0


def test_parities_bound_the_difference():
    rnd = np.random.default_rng(3)
    for n in (1, 5, 300, 3000):
        x = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        for more in (0, 1, n // 4, 2 * n):
            y = np.unique(np.concatenate([x[more // 2 :], rnd.integers(0, 1 << 63, more, dtype=np.uint64)]))
            if len(y):
                low = nearcopies.differ(nearcopies.parities(x).tobytes(), nearcopies.parities(y).tobytes())
                assert low <= len(np.setxor1d(x, y)) and (low > 0) == (more > 0)


def test_short_parities_bound_the_difference():
    rnd = np.random.default_rng(5)
    for n in (1, 5, 300, 3000):
        x = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        for more in (0, 1, n // 4, 2 * n):
            y = np.unique(np.concatenate([x[more // 2 :], rnd.integers(0, 1 << 63, more, dtype=np.uint64)]))
            if len(y):
                a, b = (nearcopies.brief(nearcopies.parities(s).tobytes()) for s in (x, y))
                assert len(a) == 4 and int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) <= len(np.setxor1d(x, y))


def test_rows_of_a_key_make_few_pairs_and_miss_none():
    rnd = np.random.default_rng(6)
    base = rnd.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.where(rnd.random(200) < rnd.random() / 5, rnd.integers(0, 1 << 63, 200, dtype=np.uint64), base)) for _ in range(150)]
    sets.sort(key=len)
    n, node = np.array([len(s) for s in sets]), np.array([nearcopies.node_of(s) for s in sets])
    marks = np.array([nearcopies.brief(nearcopies.parities(s).tobytes()) for s in sets]).T
    key, at = np.repeat([4, 9], 150), np.zeros(300, np.int64)
    led = nearcopies.led_rows(key, np.tile(node, 2), np.tile(n, 2))
    assert led.shape[1] <= 600
    root = np.where(np.arange(150) < 40, node[0], node)
    close = set(map(tuple, nearcopies.close_rows(key, np.tile(node, 2), np.tile(n, 2), at, np.tile(root, 2), *(np.tile(m, 2) for m in marks)).T.tolist()))
    near = {(max(node[i], node[j]), min(node[i], node[j])) for i in range(150) for j in range(max(i + 1, 40), 150) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (n[i] + n[j])}
    assert len(near) > 100 and near <= close and len(close) < 150 * 149 // 4
    assert not nearcopies.close_rows(key, np.tile(node, 2), np.tile(n, 2), at, np.zeros(300, np.int64), *(np.tile(m, 2) for m in marks)).size


def test_sides_roots_and_wide_marks_leave_the_right_pairs():
    rnd = np.random.default_rng(7)
    for m, most in ((40, 90), (900, 1 << 18)):
        key, n = np.sort(rnd.integers(0, 3, m)), rnd.integers(80, 130, m)
        order = np.lexsort((n, key))
        key, n, node = key[order], n[order], rnd.permutation(m)
        root, side, at = rnd.integers(0, 4, m), np.where(key == 1, rnd.integers(1, 3, m), 0), np.zeros(m, np.int64)
        got = [tuple(p) for part in nearcopies.close_parts(key, node, n, at, root, side=side, part=most * 256) for p in part.T.tolist()]
        want = set()
        for i in range(m):
            for j in range(i + 1, m):
                if key[i] == key[j] and root[i] != root[j] and 4 * n[j] <= 5 * n[i] and {side[i], side[j]} in ({0}, {1, 2}) and 9 * n[i] >= 4 * (n[i] + n[j]):
                    want.add((max(node[i], node[j]), min(node[i], node[j])))
        assert set(got) == want and len(got) == len(want)


def test_a_large_joined_group_costs_its_rows_only():
    m = 200_000
    node, zero, n = np.arange(m), np.zeros(m, np.int64), np.full(m, 200)
    start = time.process_time()
    assert nearcopies.close_rows(zero, node, n, zero, zero).size == 0
    assert nearcopies.close_rows(zero, node, n, zero, np.where(node == 7, 7, 0)).shape == (2, m - 1)
    assert time.process_time() - start < 5


def test_wide_marks_tell_long_sets_apart():
    rnd = np.random.default_rng(8)
    sets = [np.unique(rnd.integers(0, 1 << 63, 3000, dtype=np.uint64)) for _ in range(30)]
    sets += [np.sort(np.append(sets[0][:-100], rnd.integers(0, 1 << 63, 100, dtype=np.uint64)))]
    sets.sort(key=len)
    n, node, zero = np.array([len(s) for s in sets]), np.arange(31), np.zeros(31, np.int64)
    wides = np.stack([np.frombuffer(nearcopies.wide(s), "<u8") for s in sets])
    near = [(j, i) for i in range(31) for j in range(i + 1, 31) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (n[i] + n[j])]
    assert len(near) == 1 and nearcopies.wide(sets[0][:512]) is None
    assert [tuple(p) for part in nearcopies.close_parts(zero, node, n, zero, node, wides=wides) for p in part.T.tolist()] == near


def test_tiles_bring_every_pair_of_roots_together(spark):
    rnd = random.Random(9)
    rows = [(k, 1000 * k + i, 100, 0, 0 if k == 1 else rnd.randrange(1, 1 + 3 * k)) for k, m in ((1, 50), (2, 60), (3, 7), (5, 40)) for i in range(m)]
    tiles = {}
    for r in nearcopies._tiles(spark.createDataFrame(rows, "key long, node long, n long, at long, root long"), 8).collect():
        tiles.setdefault(r.tile, []).append((r.node, r.root, r.side))
    met = {(min(a, b), max(a, b)) for t in tiles.values() for a, x, s in t for b, y, o in t if x != y and {s, o} in ({0}, {1, 2})}
    assert met == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[4] != b[4]}
    assert max(map(len, tiles.values())) < 40
