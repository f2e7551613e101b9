"""The resumable run: nothing that is committed is called again, and a run that is stopped ends like one that is not."""

import collections
import json

import pytest

from tapeloom.functions import scalars
from tapeloom.operators import runs
from tapeloom.plans import queries
from tapeloom.plans.scratch import shared_path

URLS = [f"https://youtu.be/{k}" for k in range(6)]


def inputs(spark):
    from pyspark.sql import functions as F

    urls = spark.createDataFrame([(u,) for u in URLS] + [(" ",), (None,)], "url string")
    ids = urls.where("trim(url) <> ''").select("url", scalars.job_id(F.col("url")).alias("job_id"))
    media = ids.select("job_id", F.when(F.col("url") == URLS[5], None).otherwise(600.0).alias("duration_seconds"))
    contents = ids.select("job_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("chunk_idx"), "url").select("job_id", F.col("chunk_idx").cast("int").alias("chunk_idx"), F.encode(F.concat_ws("#", "url", "chunk_idx"), "utf-8").alias("content"))
    return urls, media, contents


def model(log, bad=()):
    """Writes down each call; fails on what ends with one of ``bad``."""
    log, bad = str(log), tuple(bad)

    def call(content):
        text = bytes(content).decode()
        with open(log, "a") as f:
            f.write(text + "\n")
        if text.endswith(bad):
            raise RuntimeError("denied")
        return json.dumps({"output": {"text": text.upper()}})

    return call


def calls(log):
    return collections.Counter(log.read_text().split())


def test_stopped_runs_resume_without_calling_again(spark, tmp_path):
    urls, media, contents = inputs(spark)
    store = runs.RunStore(spark, shared_path(spark, "runs"))
    log = tmp_path / "calls"

    def stop(number, unit):
        if unit == 1:
            raise queries.Stopped

    with pytest.raises(queries.Stopped):
        runs.transcription_run(urls, media, contents, model(log, ["2#3"]), store, unit_chunks=6, on_unit=stop)
    first = calls(log)
    committed = {(r.job_id, r.chunk_idx) for r in store.results().collect()}
    assert 0 < len(first) < 25 and len(committed) == len(first) - ("https://youtu.be/2#3" in first)
    assert store.patches().count() == 0

    got = {r.source_url: r for r in runs.transcription_run(urls, media, contents, model(log, ["2#3"]), store, unit_chunks=6).collect()}
    again = calls(log)
    assert len(again) == 25 and all(n == 1 for k, n in again.items() if k != "https://youtu.be/2#3")
    bad = got[URLS[2]]
    assert (bad.status, bad.error, bad.completed_chunks, bad.next_resume_chunk, bad.last_completed_chunk) == ("failed", "denied", 4, 3, 4)
    assert got[URLS[0]].status == "complete" and got[URLS[0]].transcript.startswith("## Chunk 1\n\nHTTPS://YOUTU.BE/0#0\n\n## Chunk 2")
    assert (got[URLS[5]].status, got[URLS[5]].total_chunks) == ("unknown", 0) and len(got) == 6

    got = {r.source_url: r for r in runs.transcription_run(urls, media, contents, model(log), store).collect()}
    last = calls(log)
    assert sum((last - again).values()) == 1  # the one chunk that had failed
    assert (got[URLS[2]].status, got[URLS[2]].error) == ("complete", "denied")  # a merged checkpoint keeps an earlier error
    runs.transcription_run(urls, media, contents, model(log), store)
    assert calls(log) == last


def test_a_unit_that_fails_leaves_the_others(spark, tmp_path):
    urls, media, contents = inputs(spark)
    store = runs.RunStore(spark, shared_path(spark, "runs"))
    seen = []

    def lose(number, unit):
        seen.append(unit)
        if len(seen) == 3:
            raise OSError("the driver is gone")

    with pytest.raises(OSError):
        runs.transcription_run(urls, media, contents, model(tmp_path / "a"), store, unit_chunks=5, on_unit=lose)
    done = store.results().count()
    assert 0 < done < 25
    assert runs.transcription_run(urls, media, contents, model(tmp_path / "b"), store).where("status = 'complete'").count() == 5
    assert sum(calls(tmp_path / "b").values()) == 25 - done


def test_a_run_makes_its_plan_once_and_units_pick_their_rows_before_they_join(spark, tmp_path):
    from pyspark.sql import functions as F

    urls, media, contents = inputs(spark)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    store = runs.RunStore(spark, shared_path(spark, "runs"))
    wide = contents.withColumn("chunk_idx", F.col("chunk_idx").cast("long"))
    got = runs.transcription_run(urls, media.mapInPandas(counted, media.schema), wide, model(tmp_path / "calls"), store, unit_chunks=6)
    assert made.value == len(URLS)
    texts = {r.source_url: r.transcript for r in got.collect() if r.status == "complete"}
    assert len(texts) == 5 and all(f"{u.upper()}#4" in t for u, t in texts.items())
    parts = [[(r.job_id, r.chunk_idx) for r in runs._unit(k, 3)(rows).select("job_id", "chunk_idx").collect()] for rows in (contents, wide) for k in range(3)]
    assert [sorted(p) for p in parts[:3]] == [sorted(p) for p in parts[3:]] and sum(map(len, parts[:3])) == contents.count()
