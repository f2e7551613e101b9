"""Files of texts that tasks write themselves: one for each row, equal numbers too, and the same when written again."""

from tapeloom.plans import queries
from tapeloom.sources import readers, writers


def test_a_file_for_each_row_and_none_twice(spark, tmp_path):
    rows = [(1, 0, "a"), (1, 0, "a"), (1, 0, "b\nc"), (1, 100, ""), (2, 7, "ü"), (3, 1, None)]
    df = spark.createDataFrame(rows, "job long, turn int, text string")
    for _ in range(2):
        writers.write_text_files(df, str(tmp_path / "x"))
        got = readers.read_chunk_results(spark, str(tmp_path / "x"), readers.path_key(queries.TURN_JOB), queries.TURN_FILE)
        assert sorted((r.job_id, r.chunk_idx, r.text) for r in got.collect()) == [("1", 0, "a\n"), ("1", 0, "a\n"), ("1", 0, "b\nc\n"), ("1", 100, "\n"), ("2", 7, "ü\n"), ("3", 1, "\n")]
    assert (writers.local_folder("/a/b"), writers.local_folder("file:///a%20b"), writers.local_folder("hdfs://x/a")) == ("/a/b", "/a b", None)


def test_repeated_turns_are_files_of_their_own(spark, tmp_path):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "y"), (1, 1, "user", "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted((r.chunk_idx, r.text) for r in queries.read_chunk_results(spark, str(tmp_path)).collect()) == [(0, "x\n"), (0, "y\n"), (1, "z\n")]
