import hashlib
import random

import duckdb
import numpy as np

from tapeloom.llm import queries, substrings


def brute(rows, n):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        for s in range(len(w) - n + 1):
            first.setdefault(tuple(w[s : s + n]), (i, s))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        if i is not None:
            for s in range(len(w) - n + 1):
                if first[tuple(w[s : s + n])] != (i, s):
                    gone |= set(range(s, s + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    for n, vocab in ((6, "abc"), (20, "abcdefghijklmnop"), (4, "ab")):
        passages = [[rnd.choice(vocab) for _ in range(rnd.randrange(n - 2, 3 * n))] for _ in range(5)]
        rows = [(1, None), (2, ""), (3, " \n"), (4, "x " * 300), (None, "a b " * 60), (5, "é y " * 30)]
        for i in range(10, 80):
            w = []
            for _ in range(rnd.randrange(6)):
                w += rnd.choice(passages) if rnd.random() < 0.6 else [rnd.choice(vocab) for _ in range(rnd.randrange(2 * n))]
            rows.append((i, " ".join(w)))
        rows.append((30, rows[30][1]))  # a repeated row's id, other text
        rows = [r for k, r in enumerate(rows) if r[0] != 30 or k == len(rows) - 1]
        rnd.shuffle(rows)
        df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, chunk string").repartition(3)
        for first in {n // 2, n // 4 if n % 4 == 0 else n // 2}:
            got = substrings.remove_repeats(df, min_words=n, chunk_words=400, bucket_hashes=64, first=first)
            assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute(rows, n)


def test_repeated_rows_and_empty_table(spark):
    w = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, w), (1, w), (2, w)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, r.text) for r in substrings.remove_repeats(df).collect())
    assert got == [(1, 0, w), (1, 0, w), (2, 30, "")]
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_ids_that_are_no_numbers(spark):
    w = [" ".join(f"w{k}-{n}" for k in range(30)) for n in range(4)]
    rows = [(f"doc{i:02}", w[i % 4] + (f" own{i}" * 25 if i % 3 else "")) for i in range(12)] + [(None, w[0]), ("empty", None), ("\u00e9", w[1])]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id string, text string, name string, id int")
    for part in (df, df.repartition(5)):
        got = substrings.remove_repeats(part, chunk_words=100)
        assert got.columns == ["doc_id", "text_hash", "n_words", "n_removed", "kept_sha256", "text"]
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute(rows, 20)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_whole_table_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.op7_substring_dedup(spark, sf)
    want = con.sql(queries.ORACLE["op7_substring_dedup"])
    assert got.columns == want.columns and [str(x) for x in want.types] == ["BIGINT", "BIGINT", "BIGINT", "VARCHAR"]
    rows = want.fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows) and sum(r[2] > 0 for r in rows) > 50


def test_levels_end_when_nothing_survives(spark, monkeypatch):
    """Long passages pass every level; short repeats end at theirs."""
    seen = []
    real = substrings.materialise
    monkeypatch.setattr(substrings, "materialise", lambda df, name, *more: (seen.append(name), real(df, name, *more))[1])
    rnd = random.Random(8)
    passage, short = [f"p{k}" for k in range(130)], [f"s{k}" for k in range(12)]
    own = lambda i: [f"w{rnd.randrange(10**9)}-{i}" for _ in range(60)]
    for repeat, levels in ((passage, ["windows-5", "windows-10"]), (short, ["windows-5", "windows-10"]), (short[:7], ["windows-5", "windows-10"]), (short[:4], ["windows-5"])):
        rows = [(i, " ".join(own(i) + repeat + own(i))) for i in range(30)]
        seen.clear()
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = substrings.remove_repeats(df, chunk_words=500, first=5)
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute(rows, 20)
        assert [x for x in seen if x.startswith("windows-")] == levels


def test_windows_that_share_a_hash_are_told_apart():
    keys, checks = np.array([3, 7, 7, 7, 9], np.uint64), np.array([1, 2, 4, 8, 1], np.uint32)
    assert substrings._find(keys, checks, np.array([7, 7, 3, 9, 7], np.uint64), np.array([8, 2, 1, 1, 4], np.uint32)).tolist() == [3, 1, 0, 4, 2]
