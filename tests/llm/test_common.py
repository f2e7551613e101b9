import random
from pathlib import Path

import numpy as np

from tapeloom.llm import common, nearcopies, simhash


def test_connected_components(spark):
    rnd = random.Random(0)
    edges = [(0, k) for k in range(1, 200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000 + rnd.randrange(80), 5000 + rnd.randrange(80)) for _ in range(60)] + [(7, 7), (3, 0), (0, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in root}
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables_that_no_plan_reads_are_deleted(spark):
    """What stays are the tables that a result reads."""
    docs = spark.createDataFrame([(i, f"a b c d e f g {i % 3}") for i in range(12)], "doc_id long, text string")
    base = Path(common.shared_dir(spark).removeprefix("file:"))
    for find, stay in ((simhash.near_duplicates, {"fingerprints", "components"}), (nearcopies.groups, {"groups"})):
        before = set(base.glob("tapeloom-*"))
        out = find(docs)
        assert {p.name.split("-")[1] for p in set(base.glob("tapeloom-*")) - before} == stay
        assert out.count() == 12


def test_words_and_mix():
    assert common.words_of("A\x85b\x1c \tC\x0bÉ", lower=True) == ["a\x85b\x1c".encode(), b"c", "É".encode()]
    assert common.words_of(None) == [] == common.words_of(" \r\n")
    x = np.arange(100000, dtype=np.uint64)
    assert len(np.unique(common.mix(x, x[::-1]))) == len(x) and (common.mix(x, x + np.uint64(1)) != common.mix(x + np.uint64(1), x)).all()
