from tapeloom.operators import chunks
from tapeloom.sources.snapshots import Snapshots
from tapeloom.streaming import live


def test_words_of_batches_merge_by_bits_without_state(spark, tmp_path):
    rows = [[(1, 0, "x"), (2, 70, "y")], [(1, 5, "x"), (1, 0, " "), (3, 1, "")], [(2, 3, "z"), (1, 0, "x")], [(1, 64, "w")]]
    store, folder = Snapshots(spark, str(tmp_path / "out"), ("job_id", "word")), str(tmp_path / "in")
    for k, some in enumerate(rows):
        spark.createDataFrame(some, "job_id long, chunk_idx int, text string").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("job_id long, chunk_idx int, text string").option("maxFilesPerTrigger", 1).parquet(folder)
    query = live.stream_chunk_words(stream, store, str(tmp_path / "cp"))
    query.awaitTermination()
    assert all(not p["stateOperators"] for p in query.recentProgress)
    want = {(1, 0): 1 | 1 << 5, (1, 1): 1, (2, 0): 1 << 3, (2, 1): 1 << 6}
    assert {(r.job_id, r.word): r.bits for r in store.read().collect()} == want
    # a batch that comes again changes nothing
    store.upsert(chunks.chunk_words(spark.createDataFrame(rows[0], "job_id long, chunk_idx int, text string")))
    assert {(r.job_id, r.word): r.bits for r in store.read().collect()} == want
