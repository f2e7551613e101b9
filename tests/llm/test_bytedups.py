import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tapeloom.llm import bytedups, queries
from tapeloom.llm.suffixgroups import suffix_array


def brute(rows, n):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(hash(t[s : s + n]) for t in texts for s in range(len(t) - n + 1))
    out = []
    for (key, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, int)
        for s in range(len(t) - n + 1):
            if seen[hash(t[s : s + n])] > 1:
                gone[s] += 1
                gone[s + n] -= 1
        stay = np.cumsum(gone)[: len(t)] == 0
        kept = bytes(b for b, k in zip(t, stay) if k)
        spans = sum(1 for k in range(len(t)) if not stay[k] and (k == 0 or stay[k - 1]))
        out.append((str(key), len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((str(r[0]), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_suffix_array_is_sorted():
    rnd = random.Random(1)
    for _ in range(3000):
        x = [rnd.randrange(rnd.choice([1, 2, 3, 50])) - 3 for _ in range(rnd.randrange(40))]
        assert suffix_array(np.array(x, int)) == sorted(range(len(x)), key=lambda i: x[i:])


@pytest.mark.parametrize("n,kw", [(12, {"chunk_bytes": 300, "group": 3, "at_once": 4}), (40, {"chunk_bytes": 5000, "group": 4, "at_once": 1}), (9, {"chunk_bytes": 1 << 20})])
def test_matches_brute_force(spark, n, kw):
    rnd = random.Random(n)
    letters = "abcdefghij é"
    passages = ["".join(rnd.choices(letters, k=rnd.randrange(n - 3, 4 * n))) for _ in range(6)]
    hot = "".join(rnd.choices(letters, k=2 * n))
    rows = [(1, None), (2, ""), (3, "x" * 5 * n), (4, "xy" * 3 * n), (None, passages[0] * 2), (5, "short")]
    for i in range(10, 90):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else "".join(rnd.choices(letters, k=rnd.randrange(3 * n))) for _ in range(rnd.randrange(5))]
        rows.append((i, "".join(parts)))
    for i in range(90, 120):  # a passage in many documents, each with other text around it
        rows.append((i, "".join(rnd.choices(letters, k=2 * n)) + hot + "".join(rnd.choices(letters, k=2 * n))))
    rows += [rows[20], (1000, rows[21][1]), rows[21]]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, piece string").repartition(3)
    got = bytedups.remove_repeats(df, min_bytes=n, **kw)
    assert found(got) == brute(rows, n)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())


def test_empty_table_and_string_ids(spark):
    assert bytedups.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([("a", "t" * 50), ("b\n", "u" * 20)], "doc_id string, text string")
    assert sorted((r.doc_id, r.n_removed) for r in bytedups.remove_repeats(df, min_bytes=30).collect()) == [("a", 50), ("b\n", 0)]


def test_windows_have_equal_anchors_wherever_they_are():
    rnd = random.Random(2)
    w = bytedups.Windows(400)
    part = bytes(rnd.choices(b"abcd ", k=1500))
    raw = bytes(rnd.choices(b"abcd ", k=700_001)) + part + b"--" + part
    starts, anchors = w.anchors(raw, np.array([len(raw)]))
    lead = dict(zip(starts.tolist(), (anchors - starts).tolist()))
    at = len(raw) - len(part)
    assert [lead[s] for s in range(at, at + 1101)] == [lead[s - len(part) - 2] for s in range(at, at + 1101)]
    assert min(lead.values()) >= w.low and max(lead.values()) < w.low + w.wide


def test_whole_table_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_suffix_dedup(spark, "/root/testdata/sf0.001")
    assert [t for _, t in got.dtypes] == ["bigint"] * 4 + ["string"]
    assert found(got) == brute(rows, 400)
