import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import annforest, queries, topk

SF, SF_LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, score string"


def edge_rows():
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 4], "s") for i in range(60)]
    rows += [(60, None, "s"), (61, [1.0, None, 0.0, 0.0], "s"), (62, [float("nan"), 0.0, 0.0, 0.0], "s"), (63, [float("inf"), 0.0, 0.0, 0.0], "s"), (64, [], "s"), (65, [0.0] * 4, "s"), (None, [1.0] * 4, "s"), (66, [1.0, 2.0], "s"), (70, [0.5] * 4, None), (71, [0.5] * 4, None), (7, rows[7][1], "s")]
    return rows


def test_topk_matches_sql(spark):
    got = queries.op2_exact_topk(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(queries.ORACLE["op2_exact_topk"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 50


def test_topk_edges(spark):
    rows = edge_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    ok = [(i, np.floor(256 * np.array(v))) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for q, a in {i: a for i, a in ok if i % 5 == 0}.items():
        c = sorted((-int(a @ b), i) for i, b in ok if i != q and len(a) == len(b))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(c)]
    for block, ask in ((1024, 2048), (7, 2048), (7, 4), (1024, 4)):
        got = topk.top_inner_products(df, F.col("vec_id") % 5 == 0, block=block, ask=ask)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_inner_products(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


@pytest.mark.parametrize("sf, n", [(SF, 5), (SF_LARGE, 20)])
def test_forest_recall(spark, sf, n):
    """All queries against brute force."""
    got = {}
    for r in queries.op4_ann_forest(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    e = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in e], float), np.array([r.vec_id for r in e])
    hits = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        near = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, 11))
        assert all(abs(far[ids == i][0] - s) < 1e-9 for _, i, s in got[q])
        hits += len({ids[i] for i in near} & {i for _, i, _ in got[q]})
    assert hits >= 0.9 * 10 * len(got) and len(got) == n


def test_forest_edges(spark):
    rows = edge_rows()
    got = annforest.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0, share=1.0, block=20).collect()
    ok = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    want = {}
    for q, a in ok:
        if q % 5 == 0:
            want[q] = [i for _, i in sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for i, b in ok if i != q and len(a) == len(b))[:10]]
    assert {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] for q in {r.query_id for r in got}} == {q: w for q, w in want.items() if w}


def test_threshold_stops_early_where_few_components_dominate():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.pareto(1.5, (4000, 16))).astype(np.int64)
    lists = topk.Lists(np.arange(4000), x)
    for q in x[:20]:
        ids, scores = lists.top(-1, q, 5)
        want = np.lexsort((np.arange(4000), -(x @ q)))[:5]
        assert ids.tolist() == want.tolist() and scores.tolist() == (x @ q)[want].tolist()
    assert lists.scored < 0.25 * 20 * 4000
    with pytest.raises(ValueError):
        topk.Lists(np.arange(1), np.array([[2**40]])).top(5, np.array([2**30]), 1)


def test_scores_near_the_end_of_a_long():
    near = [[2**40, 1], [2**41, -1], [5, 5]], [[2**21, 2**21], [2**20, -3]]
    apart = [[2**52, -(2**52)], [5, 5]], [[2**52, 2**52]]  # sums pass a long on their way, their result does not
    for x, queries in (near, apart):
        for q in queries:
            _, got = topk.Lists(np.arange(len(x)), np.array(x)).top(9, np.array(q), 1)
            assert got.tolist() == [max(a * q[0] + b * q[1] for a, b in x)]


def test_forest_stops_early_where_neighbours_are_close():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(100, 32))[rng.integers(0, 100, 6000)] + 0.2 * rng.normal(size=(6000, 32))
    forest, hits = annforest.Forest(np.arange(6000), x, x.mean(0), 64, 48, 7), 0
    low, high = forest.ranges(x[:100])
    for q in range(100):
        ids, far = forest.near(q, x[q], low[:, :, q], high[:, :, q], 10, 0.95, 0)
        true = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert far.tolist() == true[ids].tolist() and sorted(far) == far.tolist()
        hits += len(set(np.argsort(true, kind="stable")[1:11]) & set(ids))
    assert hits >= 900 and forest.scored < 0.1 * 100 * 6000


def test_tiles_give_the_same_rows(spark):
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    asks = F.col("vec_id") % 5 == 0
    want = sorted(map(tuple, annforest.nearest(df, asks, share=1.0).collect()))
    assert sorted(map(tuple, annforest.nearest(df, asks, share=1.0, block=20, ask=3).collect())) == want
    assert annforest.nearest(df.limit(0), asks).count() == 0


def test_rows_of_one_query_id_ask_once(spark):
    rows = [(5, [1.0, 0.0], "s"), (5, [0.0, 1.0], "s"), (1, [1.0, 0.0], "s"), (2, [0.0, 1.0], "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    for part in (df, df.repartition(3)):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in annforest.nearest(part, F.col("vec_id") == 5).collect())
        assert got == [(5, 1, 2, 0.0), (5, 2, 1, 2**0.5)]
        assert sorted(map(tuple, topk.top_inner_products(part, F.col("vec_id") == 5).collect())) == [(5, 1, 2, 65536), (5, 2, 1, 0)]
