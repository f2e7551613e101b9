import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tapeloom.llm import lmscore, queries

SF = "/root/testdata/sf0.01"


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def check(spark, rows, learn, got, power=0.9, tolerance=0.02):
    """Exact figures by brute force; the model against itself with exact levels, up to the filter's false hits."""
    c1, c2 = Counter(), Counter()
    for i, t in rows:
        if learn(i):
            w = tokens(t)
            c1.update(w)
            c2.update(zip([b"\n", *w], w))
    n, v = sum(c1.values()), len(c1)
    q = lambda c: float(lmscore.count_of(np.array([c.bit_length()]))[0])
    off = 0
    for (i, t), r in zip(rows, got):
        w = tokens(t)
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (i, len(w), sum(x in c1 for x in w), n)
        assert abs(r.base_score - sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w)
        model = 0.0
        for h, x in zip([b"\n", *w], w):
            flat, ch = (q(c1[x]) + 1) / (n + v + 1), q(c1[h])
            model += math.log10((min(q(c2[h, x]), ch) + ch**power * flat) / (ch + ch**power) if ch else flat)
        off += abs(r.score - model) / max(1, abs(model))
    assert off / max(1, len(rows)) < tolerance


def test_scores_and_held_out_gain(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(queries.op3_lm_score(spark, SF).collect(), key=lambda r: r.doc_id)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    assert all(r.held_out == held(r.doc_id) for r in got)
    check(spark, docs, lambda i: not held(i), got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_asked_filter_and_edges(spark, monkeypatch):
    rows = [(0, None), (1, ""), (2, "a b A b a"), (3, "x " * 3000), (4, "é É a"), (6, "new words only"), (7, "a b")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    learn = F.col("doc_id") != 6
    one = sorted(lmscore.score(df, learn).collect())
    monkeypatch.setattr(lmscore, "whole", lambda *_: 1 / 0)  # a filter over max_bytes never comes to the driver
    for chars in (4_000_000, 20):
        many = sorted(lmscore.score(df, learn, max_bytes=64, batch_chars=chars).collect())
        for a, b in zip(one, many):
            assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-9 and abs(a[5] - b[5]) < 1e-9
    monkeypatch.undo()
    check(spark, rows, lambda i: i != 6, one, tolerance=0.2)
    got = lmscore.score(df.union(df).union(spark.createDataFrame([(None, "a", 0.0)], df.schema)), learn).collect()
    assert len(got) == 15
    for most in (1 << 20, -1):
        none = lmscore.score(df, F.lit(False), max_bytes=most).collect()
        assert len(none) == 7 and all(r.base_score == r.score == 0 and r.n_known == r.train_tokens == 0 for r in none)
        assert lmscore.score(df.limit(0), learn, max_bytes=most).count() == 0


def test_whole_table_gives_the_same_rows_when_shards_are_asked(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learn = F.col("doc_id") % 7 != 2
    one, many = (sorted(lmscore.score(docs, learn, max_bytes=most).collect()) for most in (256 << 20, 1000))
    assert len(one) == docs.count()
    for a, b in zip(one, many, strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 and abs(a[5] - b[5]) < 1e-6


def test_words_that_share_64_bits_keep_their_own_counts():
    keys, checks, counts = np.array([5, 9, 9, 9], np.uint64), np.array([1, 2, 3, 7], np.uint64), np.array([10, 20, 30, 40])
    asked = np.array([9, 9, 9, 9, 5, 5, 4, 11], np.uint64), np.array([3, 2, 7, 8, 1, 2, 1, 1], np.uint64)
    assert lmscore.exact(*asked, keys, checks, counts).tolist() == [30, 20, 40, 0, 10, 0, 0, 0]
