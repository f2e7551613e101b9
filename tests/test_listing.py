"""Many small folders are listed by few tasks, and the setting is as before afterwards."""

from tapeloom.plans import queries
from tapeloom.sources import readers, writers

LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    rows = [(k, k % 3, f"text {k}") for k in range(150)]
    writers.write_text_files(spark.createDataFrame(rows, "job long, turn int, text string"), str(tmp_path / "x"))
    sc, before = spark.sparkContext, spark.conf.get(LISTING)
    for k, read in enumerate((readers.read_chunk_results, readers.list_chunk_files)):
        sc.setJobGroup(f"listing-{k}", "")
        files = read(spark, str(tmp_path / "x"), key=readers.path_key(queries.TURN_JOB), pattern=queries.TURN_FILE)
        sc.setLocalProperty("spark.jobGroup.id", None)
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(f"listing-{k}")]
        tasks = [sc.statusTracker().getStageInfo(n).numTasks for j in jobs for n in j.stageIds]
        assert 1 <= len(tasks) and max(tasks) <= max(32, 8 * sc.defaultParallelism) < len(rows)
        assert spark.conf.get(LISTING) == before
        assert files.count() == len(rows)


def test_results_are_the_bytes_of_their_files(spark, tmp_path):
    texts = {1: b"a\r\nb", 2: "\ufeffü".encode(), 3: b"x\x00y\n"}
    (tmp_path / "job").mkdir()
    for k, raw in texts.items():
        (tmp_path / "job" / f"chunk-{k:03d}.txt").write_bytes(raw)
    got = readers.read_chunk_results(spark, str(tmp_path))
    assert {r.chunk_idx: r.text.encode() for r in got.collect()} == texts and {r.job_id for r in got.collect()} == {"job"}
