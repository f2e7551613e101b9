"""Goldens and edge cases of the operators, batch and streaming twins, sources and sinks."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import attempts, chunks, events, inference, jobs, streaks
from tapeloom.plans.scratch import shared_path
from tapeloom.sources import readers, writers
from tapeloom.streaming import live

STATE = ["2026-04-30T08:01:25.569Z", "2026-05-01T08:01:25.569Z", "2026-05-04T08:01:25.569Z", "2026-05-12T08:01:25.569Z", "2026-05-19T08:01:25.569Z", "2026-05-24T08:01:25.569Z", "2026-06-06T14:54:10.319Z", "2026-06-06T14:54:10.699Z", "2026-06-06T14:54:10.898Z"]
STARTED = "2026-04-27T08:01:25.569Z"


def ms(iso):
    return round(dt.datetime.fromisoformat(iso.replace("Z", "+00:00")).timestamp() * 1000)


def tables(spark, rows, started=STARTED):
    users = spark.createDataFrame([("u", ms(started))], "user_id string, started_ms long")
    return users, spark.createDataFrame([("u", r) for r in rows], "user_id string, ts_ms long")


@pytest.mark.parametrize(
    ("now", "n", "days", "current", "best", "avg", "rank", "karma"),
    [
        ("2026-06-06T14:54:10.898Z", 9, [3.0, 1.0, 3.0, 8.0, 7.0, 5.0, 13.3, 0.0, 0.0, 0.0], (0.0, "0h"), (13.3, "13d"), (4.0, "4d"), 72, 7),
        ("2026-06-10T08:01:25.569Z", 9, [3.0, 1.0, 3.0, 8.0, 7.0, 5.0, 13.3, 0.0, 0.0, 3.7], (3.7, "4d"), (13.3, "13d"), (4.4, "4d"), 55, 10),
        ("2026-05-20T08:01:25.569Z", 5, [3.0, 1.0, 3.0, 8.0, 7.0, 1.0], (1.0, "1d"), (8.0, "8d"), (3.8, "4d"), 72, 5),
        ("2026-07-31T08:01:25.569Z", 9, [3.0, 1.0, 3.0, 8.0, 7.0, 5.0, 13.3, 0.0, 0.0, 54.7], (54.7, "55d"), (54.7, "55d"), (9.5, "10d"), 10, 82),
        ("2026-04-20T00:00:00.000Z", 0, [0.0], (0.0, "0h"), (0.0, "0h"), (0.0, "0h"), 72, 1),
    ],
)
def test_streak_goldens(spark, now, n, days, current, best, avg, rank, karma):
    users, rel = tables(spark, [ms(x) for x in STATE] + [ms(STATE[0]), ms(STARTED), None])
    st = streaks.build_streaks(rel, users, ms(now))
    r = streaks.streak_stats(st).first()
    assert (r.relapse_count, (r.current_days, r.current_label), (r.best_days, r.best_label), (r.avg_days, r.avg_label), r.rank_percent, r.karma) == (n, current, best, avg, rank, karma)
    report = streaks.streak_report(st, ms(now)).first()
    assert [s.days for s in report.streaks] == days and [p.type for p in report.progress_points] == ["relapse"] * n + ["progress"]
    assert report.relapses == [ms(x) for x in STATE[:n]] and report.stats.karma == karma and report.started_ms == ms(STARTED)


def test_seeded_state(spark):
    now = ms("2026-06-06T00:00:00Z")
    users = spark.createDataFrame([("a", None), ("b", ""), ("c", "later"), ("d", STARTED)], "user_id string, started_at string")
    rel = spark.createDataFrame([("a", now - 1), ("c", now - 86_400_000), ("d", now)], "user_id string, ts_ms long")
    state, all_rel = streaks.seed_streak_state(users, rel, now)
    got = {r.user_id: r for r in streaks.streak_stats(streaks.build_streaks(all_rel, state, now)).collect()}
    a = got["a"]
    assert (a.relapse_count, a.current_label, a.best_label, a.avg_days, a.rank_percent, a.karma) == (6, "7d", "8d", 4.9, 40, 11)
    assert got["c"].relapse_count == 1 and got["c"].best_days == 12.0 and got["d"].relapse_count == 1


def test_streaks_tile_the_time(spark):
    rnd = random.Random(1)
    rows = [rnd.randrange(0, 10**10) for _ in range(50)]
    users, rel = tables(spark, [ms(STARTED) + r for r in rows])
    now = ms(STARTED) + 10**10
    got = streaks.build_streaks(rel, users, now).collect()
    assert abs(sum(r.days for r in got) - 10**10 / 86_400_000) < 1e-6 and len(got) == len(set(rows)) + 1
    appended = streaks.record_relapse(rel.limit(0), rel, users, now).collect()
    assert sorted(appended) == sorted(got)


def test_resume_and_progress_quirks(spark):
    totals = spark.createDataFrame([(1, 3), (2, 2), (3, 0), (4, None), (5, 2)], "job_id long, total_chunks int")
    res = spark.createDataFrame([(1, 0, "a"), (1, 1, " \t"), (1, 7, "late"), (2, 0, "a"), (2, 1, "b"), (3, 4, "x"), (4, 2, "y"), (4, 3, " ")], "job_id long, chunk_idx int, text string")
    p = {r.job_id: (r.completed, r.last_completed, r.next_incomplete) for r in chunks.chunk_progress(totals, res).collect()}
    assert p == {1: (1, 0, 1), 2: (2, 1, None), 3: (1, 4, None), 4: (1, 2, None), 5: (0, None, 0)}
    plan = chunks.plan_from_totals(totals)
    key = lambda df: sorted((r.job_id, r.chunk_idx) for r in df.collect())
    assert key(chunks.pending_chunks(plan, res)) == [(1, 2), (5, 0), (5, 1)]
    assert key(chunks.pending_chunks(plan, res, blank_is_done=False)) == [(1, 1), (1, 2), (5, 0), (5, 1)]
    t = {r.job_id: r.transcript for r in chunks.rebuild_transcripts(res, totals).collect()}
    assert t[1] == "## Chunk 1\n\na" and t[2] == "## Chunk 1\n\na\n\n## Chunk 2\n\nb"
    assert {r.job_id: r.forced_complete for r in chunks.final_checkpoint(totals, res).collect()}[1]


def test_checkpoint_fold(spark):
    rows = [(1, 1, {"status": "a", "error": "boom"}), (1, 3, {"status": None}), (1, 2, {"status": "b", "currentChunk": "4"})]
    for order in (rows, rows[::-1]):
        r = jobs.fold_checkpoints(spark.createDataFrame(order, "job_id long, seq long, patch map<string,string>")).first()
        assert (r.status, r.error, r.currentChunk) == (None, "boom", "4")


def test_event_fold_stops_at_the_first_error(spark):
    rows = [("j", 1, "status", "s1", "m1", 0.0, None), ("j", 2, "partial", None, "", None, ""), ("j", 4, "error", None, None, None, None), ("j", 5, "done", None, "after", 90.0, "t"), ("k", 1, "done", None, None, None, None), ("k", 0, "status", "", "x", 250.0, "tt")]
    df = spark.createDataFrame(rows, "job_id string, seq long, type string, step string, message string, progress double, transcript string")
    got = {r.job_id: r for r in events.fold_events(df).collect()}
    assert (got["j"].message, got["j"].progress, got["j"].step, got["j"].transcript, got["j"].done, got["j"].error) == ("m1", 0.0, "s1", "", False, "未知错误")
    assert (got["k"].message, got["k"].progress, got["k"].step, got["k"].transcript, got["k"].done, got["k"].error) == ("x", 100.0, "处理中", "tt", True, None)
    path = shared_path(spark, "fold")
    for k in (3, 5, 0, 2, 1, 4):  # out of order, a file at a time
        df.where((F.col("job_id") == rows[k][0]) & (F.col("seq") == rows[k][1])).coalesce(1).write.mode("append").parquet(path)
    out = shared_path(spark, "fold-out")
    stream = live.stream_job_state(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path))
    stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.parquet(f"{out}/b={n}")).option("checkpointLocation", shared_path(spark, "fold-cp")).trigger(availableNow=True).start().awaitTermination()
    last = {r.job_id: r for r in sorted(spark.read.parquet(out).collect(), key=lambda r: r.b)}
    for job, r in got.items():
        assert all(last[job][c] == r[c] for c in ("message", "progress", "step", "transcript", "done", "error", "last_seq"))
    # with errors at most 3 numbers late, the same result from bounded state
    out = shared_path(spark, "fold-out")
    stream = live.stream_job_state(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), late=3)
    stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.parquet(f"{out}/b={n}")).option("checkpointLocation", shared_path(spark, "fold-cp")).trigger(availableNow=True).start().awaitTermination()
    last = {r.job_id: r for r in sorted(spark.read.parquet(out).collect(), key=lambda r: r.b)}
    for job, r in got.items():
        assert all(last[job][c] == r[c] for c in ("message", "progress", "step", "transcript", "done", "error", "last_seq"))


def test_attempts(spark):
    rows = [(1, 0, 1, "HTTP 503"), (1, 0, 2, None), (2, 0, 1, "bad"), (2, 0, 2, None), (3, 0, 1, "timeout"), (3, 0, 2, "timeout"), (3, 0, 3, "timeout"), (3, 0, 4, None), (4, 0, 1, "429")]
    got = {r.job_id: (r.attempts, r.state, r.backoff_ms) for r in attempts.retry_outcome(spark.createDataFrame(rows, "job_id long, chunk_idx int, attempt int, error string")).collect()}
    assert got == {1: (2, "ok", 1000), 2: (1, "failed_permanent", 0), 3: (3, "failed_exhausted", 3000), 4: (1, "in_progress", 1000)}
    rows = [(1, "ipv4", True, None), (1, "default", False, "e1"), (1, "legacy_tls", False, "e2"), (2, "default", False, "a"), (2, "ipv4", False, "b"), (2, "odd", True, None)]
    got = {r.job_id: (r.winner, r.failovers, r.error) for r in attempts.first_success(spark.createDataFrame(rows, "job_id long, strategy string, ok boolean, error string")).collect()}
    assert got == {1: ("ipv4", 1, None), 2: (None, 2, "b")}


def test_inference_and_its_attempts(spark):
    def model(content):
        text = bytes(content).decode()
        if text.startswith("!"):
            raise RuntimeError(text)
        return json.dumps({"output": {"text": text if text != "blank" else " "}})

    rows = [(1, 0, bytearray(b"hello")), (1, 1, bytearray(b"!timeout")), (1, 2, bytearray(b"!denied")), (2, 0, bytearray(b"blank"))]
    out = inference.transcribe_chunks(spark.createDataFrame(rows, "job_id long, chunk_idx int, content binary"), model, max_parallelism=2, sleep=lambda s: None)
    got = {(r.job_id, r.chunk_idx): (r.text, r.error, r.attempts) for r in out.collect()}
    assert got == {(1, 0): ("hello", None, 1), (1, 1): (None, "!timeout", 3), (1, 2): (None, "!denied", 1), (2, 0): (None, "no_text", 1)}
    states = {(r.job_id, r.chunk_idx): r.state for r in attempts.retry_outcome(inference.attempt_rows(out)).collect()}
    assert states == {(1, 0): "ok", (1, 1): "failed_exhausted", (1, 2): "failed_permanent", (2, 0): "ok"}
    with pytest.raises(Exception, match="denied"):
        inference.transcribe_chunks(spark.createDataFrame(rows[2:3], "job_id long, chunk_idx int, content binary"), model, fail_fast=True, sleep=lambda s: None).collect()


def test_sources_and_sinks(spark, tmp_path):
    for job, text in (("a", '{"totalChunks": 3,\n "kind": "video"}'), ("b", "{oops"), ("c", "")):
        (tmp_path / job / "results").mkdir(parents=True)
        (tmp_path / job / "manifest.json").write_text(text)
    for name, text in (("chunk-000.txt", "one\ntwo"), ("chunk-1000.txt", "x"), ("notes.txt", "n"), ("CHUNK-002.TXT", " ")):
        (tmp_path / "a" / "results" / name).write_text(text)
    want = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "job_id string")
    got = {r.job_id: r.totalChunks for r in readers.read_json_objects(spark, f"{tmp_path}/*/manifest.json", "totalChunks int, kind string", expected=want).collect()}
    assert got == {"a": 3, "b": None, "c": None, "d": None}
    assert {r.job_id: r.text for r in readers.read_texts(spark, f"{tmp_path}/*/manifest.json", expected=want).collect()}["d"] == ""
    key = readers.path_key(r"([^/]+)/results/[^/]+$")
    res = {r.chunk_idx: (r.job_id, r.text) for r in readers.read_chunk_results(spark, str(tmp_path), key).collect()}
    assert res == {0: ("a", "one\ntwo"), 1000: ("a", "x"), 2: ("a", " ")}
    files = readers.list_chunk_files(spark, str(tmp_path), readers.RESULT_FILE, key)
    assert "content" not in files.columns and readers.first_file(files).first().file_name == "CHUNK-002.TXT"
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "log.ndjson").write_text('{"job_id":"a","seq":1,"type":"status"}\n\n{bad\n{"job_id":"a","seq":2,"type":"done"}')
    assert sorted(str(r.seq) for r in readers.read_events(spark, str(tmp_path / "e")).collect()) == ["1", "2", "None"]
    q = writers.write_events(readers.read_events(spark, str(tmp_path / "e"), streaming=True), str(tmp_path / "sink"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert readers.read_events(spark, str(tmp_path / "sink")).where("seq is not null").count() == 2
    out = str(tmp_path / "transcripts")
    writers.write_transcripts(spark.createDataFrame([("a", "old"), ("b", "keep"), ("c", "")], "job_id string, transcript string"), out)
    writers.write_transcripts(spark.createDataFrame([("a", "new")], "job_id string, transcript string"), out)
    assert {r.job_id: r.transcript for r in spark.read.parquet(out).collect()} == {"a": "new\n", "b": "keep\n", "c": ""}
    writers.write_json_objects(want.limit(1), str(tmp_path / "docs"), "2024-01-01T00:00:00.000Z")
    assert json.loads(spark.read.text(str(tmp_path / "docs")).first().value)["updatedAt"] == "2024-01-01T00:00:00.000Z"


def test_session_zone_does_not_matter(spark):
    from tapeloom.plans import queries

    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, queries.streak_stats(spark, sf).collect()))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert sorted(map(tuple, queries.streak_stats(spark, sf).collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_submissions_and_lookups(spark):
    urls = spark.createDataFrame([(" https://youtu.be/1",), ("https://youtu.be/1 ",), (" ",), (None,)], "url string")
    good, bad = jobs.dedupe_submissions(urls)
    (job,) = good.collect()
    assert job.platform == "youtube" and bad.count() == 2
    req = spark.createDataFrame([(1, job.job_id, None), (2, "nope", "https://youtu.be/1"), (3, None, " https://youtu.be/1"), (4, "", ""), (5, None, "https://youtu.be/2")], "n int, job_id string, url string")
    assert {r.n: r.code for r in jobs.locate_job(req, good).collect()} == {1: 200, 2: 400, 3: 200, 4: 400, 5: 404}


def test_rate_is_kept_by_the_clock():
    class Clock:
        now = 0.0

        def __call__(self):
            return self.now

        def sleep(self, s):
            self.now += s

    clock, times = Clock(), []
    call = inference.with_retry(inference.Pace(4, clock, clock.sleep).paced(lambda x: times.append(clock.now) or (_ for _ in ()).throw(RuntimeError("429")) if x == "busy" else times.append(clock.now)), sleep=clock.sleep)
    for x in ["a", "b", "busy", "c"]:
        call(x)
    assert len(times) == 6 and all(b - a >= 0.25 - 1e-9 for a, b in zip(times, times[1:]))  # retries count, too
    clock.sleep(100)
    call("d")
    call("e")
    assert times[-1] - times[-2] == 0.25  # what was not used is not saved up


def test_concurrent_calls_keep_their_rows_and_share_the_rate(spark, tmp_path):
    import time

    log = str(tmp_path / "calls")

    def model(content):
        with open(log, "a") as f:
            f.write(f"{time.time()}\n")
        time.sleep(0.2)
        return json.dumps({"output": {"text": bytes(content).decode()}})

    rows = [(j, c, bytearray(f"{j}-{c}".encode())) for j in range(4) for c in range(6)]
    df = spark.createDataFrame(rows, "job_id long, chunk_idx int, content binary")
    out = inference.transcribe_chunks(df, model, max_parallelism=2, budget=inference.Budget(40, 8))
    assert {(r.job_id, r.chunk_idx): r.text for r in out.collect()} == {(j, c): f"{j}-{c}" for j, c, _ in rows}
    times = sorted(map(float, open(log).read().split()))
    assert len(times) == 24 and max(sum(t <= u < t + 0.5 for u in times) for t in times) <= 24 and times[-1] - times[0] >= 0.4
    with pytest.raises(ValueError, match="max_parallelism"):
        inference.transcribe_chunks(df, model, budget=inference.Budget(40))


def test_a_hot_user_fills_many_tasks(spark):
    now, started = 2_000 * 86_400_000, 0
    rnd = random.Random(8)
    rows = [("hot", rnd.randrange(1, now)) for _ in range(3000)] + [(f"u{k}", rnd.randrange(1, now)) for k in range(20)]
    users = spark.createDataFrame([(u, started) for u in sorted({u for u, _ in rows} | {"none"})], "user_id string, started_ms long")
    rel = spark.createDataFrame(rows, "user_id string, ts_ms long")
    got = streaks.build_streaks(rel, users, now)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") and "hashpartitioning(user_id" in plan and "_bucket" in plan
    assert rel.where("user_id = 'hot'").groupBy(F.floor(F.col("ts_ms") / streaks.BUCKET_MS)).count().agg(F.max("count")).first()[0] < 3000 / 20
    one = streaks.build_streaks(rel, users, now, bucket_ms=10 * now)  # all in one stretch
    assert sorted(got.collect()) == sorted(one.collect())
    ends = [0, *sorted({t for u, t in rows if u == "hot"}), now]
    assert sorted((r.id, r.start_ms, r.end_ms) for r in got.where("user_id = 'hot'").collect()) == [(k + 1, a, b) for k, (a, b) in enumerate(zip(ends, ends[1:]))]


def test_results_of_one_time_have_an_order(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, 0, t, at) for t in ("b", None, "c", "a")] + [(1, 1, "old", at), (1, 1, "a", at + dt.timedelta(seconds=1))]
    df = spark.createDataFrame(rows, "job_id long, chunk_idx int, text string, ingest_ts timestamp")
    for n in (1, 3, 5):
        assert {r.chunk_idx: r.text for r in chunks.latest_result(df.repartition(n)).collect()} == {0: "c", 1: "a"}
