import random

import numpy as np
import xxhash

from tapeloom.llm import queries, simhash


def brute(rows):
    fps = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= 2 and comp[a] > comp[b]:
                    comp[a] = comp[b]
                    changed = True
    return {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def test_matches_brute_force(spark):
    rnd = random.Random(1)
    vocab = [f"w{k}" for k in range(50)]
    base = [rnd.choice(vocab) for _ in range(400)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "x" * 5000)]
    for k in range(40):
        w = list(base)
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((10 + k, " ".join(w)))
    rows += [(100 + k, " ".join(rnd.choice(vocab) for _ in range(30))) for k in range(30)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, fp int")
    for tile in (1024, 4):
        got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(df, tile=tile).collect()}
        assert got == brute(rows)
    kept = {r[0] for r in simhash.keep_first(df).collect()}
    assert kept == {c for _, c in brute(rows).values()}


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, sf).collect()}
    assert got == brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_repeated_null_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "zz yy")], "doc_id long, text string")
    got = sorted((str(r[0]), str(r[2])) for r in simhash.near_duplicates(df).collect())
    assert got == [("1", "1"), ("1", "1"), ("None", "1"), ("None", "None")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_close_pairs_random():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = np.array([b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 5), False))) for b in base for _ in range(60)], np.uint64)
    ends = np.repeat([100, 300], [100, 200])
    for radius in (0, 1, 2, 3, 4):
        i, j = simhash.close_pairs(fps, ends, radius, at_once=97)
        want = {(a, b) for a in range(300) for b in range(a + 1, int(ends[a])) if bin(int(fps[a] ^ fps[b])).count("1") <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)
