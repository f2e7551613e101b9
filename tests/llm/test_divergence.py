import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tapeloom.llm import divergence, queries


def brute(rows, min_docs, top, scale=10**9):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(upper))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in docs:
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=str.encode)
        groups = {s: [c[t] for t in kept] for (x, s), c in counts.items() if x == lang}
        p = {s: [1 + scale * (n + 2) // (sum(ns) + 2 * len(kept)) for n in ns] for s, ns in (groups | {None: [sum(x) for x in zip(*groups.values())]}).items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted((-sum(map(f, p[s], p[o])), o.encode()) for o in groups if o != s)
            terms = sorted((-f(a, b), t.encode()) for t, n, a, b in zip(kept, groups[s], p[s], p[None]) if n and a > b)[:top]
            out += [(lang, s, part, item.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"bucket_terms": 8, "tile": 2, "room": 64, "entries": 50})])
def test_matches_brute_force(spark, seed, kw):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + k)}" for k in range(26)] + ["Été", "été", "ÉTÉ", "x y", "日本", "A9b", "𝄞"]
    rows = [("en", "void", None), ("en", "void2", ""), ("zz", "only", "a b c"), (None, None, "wa wb"), ("", "", "wa"), ("q", "a", "rare"), ("q", "b", "words")]
    for k in range(150):
        n = rnd.choice([0, 1, 5, 40, 400])
        rows.append((rnd.choice(["en", "de", None]), rnd.choice(["hot", "hot", "hot", *"bcdefg", None]), " ".join(rnd.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))))
    rows += rows[20:25]  # repeated rows count
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "lang string, source string, text string, term string, bucket int").repartition(5)
    got = divergence.audit(df, min_docs=5, top=4, **kw)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 4)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_shares_are_exact_for_large_counts():
    counts, total = np.array([0, 5 * 10**14, 9 * 10**14]), 9 * 10**14 + 17
    assert divergence.share(counts, 2, 10**9, total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in counts]


def test_equal_subtrees_are_one_node():
    counts = np.zeros((3, 1024), np.int64)
    counts[1, :512] = 7
    trees = divergence.Trees(counts)
    assert trees.roots[0] == trees.roots[2] != trees.roots[1]
    (pair, _, _), links = trees.traverse(np.array([0]), np.array([1]))
    assert len(pair) == 2 and max(len(low) for low, _ in links) <= 2  # of 1024 terms only two leaf pairs are priced


def test_whole_table_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.op12_source_divergence(spark, sf)
    assert [got.schema[c].dataType.simpleString() for c in ("value", "rank")] == ["bigint", "int"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.ORACLE["op12_source_divergence"]).fetchall())
