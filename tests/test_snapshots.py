"""Versions are whole: whatever fails between the writing of rows and the swap, readers keep the version before."""

import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import jobs
from tapeloom.plans.scratch import shared_path
from tapeloom.sources import writers
from tapeloom.sources.snapshots import Snapshots
from tapeloom.streaming import live

ROW = "k long, seq long, v string"


def rows(spark, *values):
    return spark.createDataFrame(values, ROW)


def content(store):
    return {r.k: (r.seq, r.v) for r in store.read().collect()}


def test_a_failure_before_the_swap_changes_nothing(spark, monkeypatch):
    store = Snapshots(spark, shared_path(spark, "table"), ("k",))
    assert store.read() is None
    store.upsert(rows(spark, (1, 1, "a"), (2, 1, "b")))
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.upsert(rows(spark, (1, 2, "new"), (3, 1, "c")))
    assert content(store) == {1: (1, "a"), 2: (1, "b")}
    began = store.read()  # a reader that has begun keeps its version
    store.upsert(rows(spark, (1, 2, "new"), (3, 1, "c")))
    assert content(store) == {1: (2, "new"), 2: (1, "b"), 3: (1, "c")}
    assert {r.k for r in began.collect()} == {1, 2}


def test_of_two_writers_the_second_fails(spark, monkeypatch):
    path = shared_path(spark, "table")
    one, two = Snapshots(spark, path, ("k",)), Snapshots(spark, path, ("k",))
    one.upsert(rows(spark, (1, 1, "a")))
    seen = two.version()
    one.upsert(rows(spark, (2, 1, "b")))
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "version", lambda self: seen)
        with pytest.raises(Exception, match="(?i)exist"):
            two.upsert(rows(spark, (3, 1, "c")))
    two.upsert(rows(spark, (3, 1, "c")))
    assert set(content(one)) == {1, 2, 3}


def test_repeated_and_reordered_batches_give_the_same_table(spark):
    rnd = random.Random(4)
    events = [(rnd.randrange(12), s, f"v{s}" if s % 5 else None) for s in range(80)]
    want = {k: max((s, v) for x, s, v in events if x == k) for k, _, _ in events}
    for seed in range(2):
        store = Snapshots(spark, shared_path(spark, "table"), ("k",), ("seq",), most=2, keep=3)
        shuffled = events + rnd.sample(events, 20)
        random.Random(seed).shuffle(shuffled)
        for n in range(0, 100, 10):
            store.upsert(rows(spark, *shuffled[n : n + 10]), "s", n)
            store.upsert(rows(spark, *shuffled[n : n + 10]), "s", n)  # a batch that is repeated after a failure
        assert content(store) == want
        assert len(store.version()["parts"]) <= 4 and len(store._manifests()) <= 4


def test_checkpoint_sink_and_transcripts(spark):
    entries = [("j", s, {"status": f"s{s}"} | ({"error": None} if s == 3 else {"error": "e"} if s == 1 else {})) for s in (2, 0, 3, 1)]
    df = spark.createDataFrame(entries, "job_id string, seq long, patch map<string,string>")
    path = shared_path(spark, "patches")
    for k in range(4):
        df.where(F.col("seq") == k if k < 2 else F.col("seq") == 5 - k).coalesce(1).write.mode("append").parquet(path)
    store = Snapshots(spark, shared_path(spark, "checkpoints"), ("job_id", "key"), ("seq",))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    live.upsert_checkpoints(stream(), store, shared_path(spark, "cp")).awaitTermination()
    want = sorted(tuple(r) for r in jobs.checkpoint_entries(df).collect())
    assert sorted((r.job_id, r.key, r.value, r.seq) for r in store.read().collect()) == want
    live.upsert_checkpoints(stream(), store, shared_path(spark, "cp")).awaitTermination()  # a new stream over the same files
    assert sorted((r.job_id, r.key, r.value, r.seq) for r in store.read().collect()) == want

    texts = Snapshots(spark, shared_path(spark, "transcripts"), ("job_id",))
    writers.upsert_transcripts(spark.createDataFrame([("a", "old"), ("b", "keep"), ("c", "")], "job_id string, transcript string"), texts)
    writers.upsert_transcripts(spark.createDataFrame([("a", "new")], "job_id string, transcript string"), texts)
    assert {r.job_id: r.transcript for r in texts.read().collect()} == {"a": "new\n", "b": "keep\n", "c": ""}
