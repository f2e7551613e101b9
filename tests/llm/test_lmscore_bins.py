"""Where the filter stays in its shards, questions are looked up by whole bins and batches, not one by one."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tapeloom.llm import lmscore


def test_questions_of_a_batch_are_looked_up_at_once(monkeypatch):
    rnd, shards, bins = np.random.default_rng(1), {1: 32, 2: 32}, {1: 4, 2: 4}
    keys = np.sort(rnd.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2))
    keys = keys[lmscore.shard_of(keys, 4) == 2]
    counts = rnd.integers(1, 40, len(keys)).astype("<u4")
    for order in (1, 2):
        checks = keys ^ np.uint64(5)
        got = lmscore._shards(pd.DataFrame({"ord": [order], "bin": [2], "keys": [keys.tobytes()], "counts": [counts.tobytes()], "checks": [checks.tobytes()]}), shards, 9.0)
        theirs = [{"ord": order, "bin": 2, "chunk": -1} | r for r in got.drop(columns=["ord", "distinct", "total"]).to_dict("records")]
        assert len(theirs) == 8 and sorted(r["shard"] for r in theirs) == list(range(16, 24))
        asked = [np.sort(rnd.choice(keys, n, replace=False)) for n in (0, 1, *[7] * 300)]
        mine = [{"ord": order, "bin": 2, "chunk": k, "keys": a.tobytes(), "checks": (a ^ np.uint64(5)).tobytes() if order == 1 else b""} for k, a in enumerate(asked)]
        kinds = pa.schema([("ord", pa.int32()), ("bin", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary()), ("shard", pa.int32()), ("bits", pa.int64()), ("filter", pa.binary()), ("counts", pa.binary())])
        calls, probe = [], lmscore.probe
        monkeypatch.setattr(lmscore, "probe", lambda *a: calls.append(1) or probe(*a))
        rows = [r for b in lmscore._answers(iter([pa.RecordBatch.from_pylist(theirs[:3], kinds), pa.RecordBatch.from_pylist(theirs[3:] + mine, kinds)]), shards, bins) for r in b.to_pylist()]
        monkeypatch.undo()
        assert len(calls) == 1 and [r["chunk"] for r in rows] == list(range(len(asked)))
        known = dict(zip(keys.tolist(), counts.tolist()))
        for a, r in zip(asked, rows):
            assert (np.frombuffer(r["levels"], "u1") >= [known[k].bit_length() for k in a.tolist()]).all()
            assert np.frombuffer(r["counts"], "<i8").tolist() == ([known[k] for k in a.tolist()] if order == 1 else [])


def test_rows_to_bins_grow_slower_than_shards():
    assert [lmscore.bins_of(1 << k) for k in (2, 9, 10, 12, 14)] == [4, 512, 512, 512, 2048]


def test_same_scores_by_any_bins(spark, monkeypatch):
    df = spark.createDataFrame([(k, " ".join(f"w{k * j % 17}" for j in range(k % 40))) for k in range(300)], "doc_id long, text string")
    learn = F.col("doc_id") % 3 > 0
    want = sorted(lmscore.score(df, learn).collect())
    for size in (1, 2, 4):
        monkeypatch.setattr(lmscore, "bins_of", lambda shards: shards // size)
        assert sorted(lmscore.score(df, learn, max_bytes=64, batch_chars=300).collect()) == want


def test_words_are_cut_at_ascii_white_space_only():
    t = lmscore.Tokens([None, "", " Ab\x0baB\u00a0\u2028c\x1c ÄB\r\n", "ab"])
    assert (t.stop - t.start).tolist() == [1, 1, 4, 2] and t.codes.tolist() == [0, 0, 1, 2, 3, 0, 1, 0]
    hashes = [lmscore.xxhash.xxh3_128_digest(w.encode()) for w in ("\n", "ab", "ab\u00a0\u2028c\x1c", "Äb")]
    assert (t.word == [int.from_bytes(h[:8], "little") for h in hashes]).all()
