import zlib

import numpy as np
from pyspark.sql import functions as F

from tapeloom.llm import queries, quality

SF = "/root/testdata/sf0.01"


def test_pairwise_identity():
    rng = np.random.default_rng(0)
    k = quality.STATISTICS
    m = quality.Model(0.3, rng.normal(size=quality.WORD_SLOTS + k), rng.normal(size=(quality.WORD_SLOTS + k, 4)), np.zeros(k), np.ones(k))
    slots, x, stats = np.array([3, 9, 70]), np.array([0.2, 0.5, -0.4]), rng.normal(size=k) / 10
    at, xs = np.append(slots, np.arange(k) + quality.WORD_SLOTS), np.append(x, stats / 2)
    z = 0.3 + m.linear[at] @ xs + sum(m.factors[at[i]] @ m.factors[at[j]] * xs[i] * xs[j] for i in range(len(at)) for j in range(i))
    assert abs(m.score(slots, x, stats) - 1 / (1 + np.exp(-z))) < 1e-9


def test_held_out_accuracy(spark):
    got = queries.op9_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert np.mean([r.predicted == r.quality for r in got]) > 0.93
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_query_scores_by_all_pairs(spark):
    """Every score of the query against pairwise terms summed one by one, by the model that the allowed labels give."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    allowed = {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    m = quality.train(docs, labels.where(F.col("doc_id").isin(sorted(allowed))), metadata=["n_chars"])
    got = {r.doc_id: r for r in queries.op9_quality(spark, sf).collect()}
    rows = docs.collect()
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        slots, x, stats = quality.features(r.text)
        d = m.dense(np.array([*stats, np.log1p(max(r.n_chars, 0))]))
        at, xs = np.concatenate([slots, np.arange(len(d)) + quality.WORD_SLOTS]), np.concatenate([x, d])
        pairs = np.triu((m.factors[at] @ m.factors[at].T) * np.outer(xs, xs), 1).sum()
        z = m.bias + m.linear[at] @ xs + pairs
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-6
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3) and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_edge_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, "a", 1.5, None), (2, "", "b", 2.5, 3), (3, "word " * 50000, None, 0.0, 4), (None, "x", "c", 1.0, 5), (3, "dup", "d", 1.0, 5)], "doc_id long, text string, lang string, score double, n_chars long")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (None, 1), (3, 1), (6, 0), (7, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels)
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "lang", "n_chars", "score", "predicted"] and len(rows) == 5
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.classify(docs, labels.where(F.lit(False))).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_repeated_ids_give_one_model_at_any_partitioning(spark):
    rows = [(i, f"{'good plain words' if (i + k) % 2 else 'BUY !!! $$$ now'} {i} {k}", 10 * k) for i in range(1, 41) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 41)], "doc_id long, quality int")
    first, *others = (sorted((r.doc_id, r.text, r.score) for r in quality.classify(docs.repartition(n), labels).collect()) for n in (1, 3, 7))
    assert all(o == first for o in others)
