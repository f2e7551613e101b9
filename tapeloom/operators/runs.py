"""A resumable transcription run over many jobs: submissions, plans, model calls in committed units, checkpoints and transcripts."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import path_exists
from . import chunks, inference, jobs

ANSWERS = "job_id string, chunk_idx int, text string, error string, attempts int, errors array<string>, run long, round int"
PATCHES = "job_id string, seq long, patch map<string,string>"


@dataclass(frozen=True)
class RunStore:
    """What runs leave behind, in two append-only tables below ``path``: every answer of the model, and checkpoint patches. Beside
    them each run keeps its plan.

    An answer is never changed. A unit of work that is lost before its commit leaves nothing that counts; one that is
    committed twice leaves rows of equal keys, of which the latest with a text counts.
    """

    spark: SparkSession
    path: str

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(path) if path_exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def answers(self) -> DataFrame:
        return self._read("answers", ANSWERS)

    def patches(self) -> DataFrame:
        return self._read("patches", PATCHES)

    def add(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def kept_plan(self, plan: DataFrame) -> DataFrame:
        """The plan as a table of its own, so that a run's steps don't make it again; the run's rows read it, too."""
        path = f"{self.path}/plan-{uuid.uuid4().hex}"
        plan.select("job_id", "chunk_idx", "total_chunks").write.parquet(path)
        return self.spark.read.schema("job_id string, chunk_idx int, total_chunks int").parquet(path)

    def results(self, part: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """(job_id, chunk_idx, text) of chunks that have an answer with a text, the latest of each; ``part`` picks chunks."""
        kept = part(self.answers()).where("text is not null")
        return chunks.latest_result(kept, F.desc("run"), F.desc("round"), F.desc("text")).select("job_id", "chunk_idx", "text")

    def next_run(self) -> int:
        """One more than the number of any run that left something."""
        last = self.answers().agg(F.max("run").alias("n")).union(self.patches().agg(F.max("seq"))).agg(F.max("n")).first()[0]
        return 1 + (last or 0)


def _unit(k: int, units: int) -> Callable[[DataFrame], DataFrame]:
    """Picks a unit's rows of any table of chunks, so that a unit's joins and windows are on its own rows only."""
    return lambda rows: rows.where(F.pmod(F.xxhash64(F.col("job_id").cast("string"), F.col("chunk_idx").cast("long")), F.lit(units)) == k)


def _untried(store: RunStore, run: int, plan: DataFrame, part: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Planned chunks without a result that this run has not tried."""
    tried = part(store.answers().where(F.col("run") == run)).select("job_id", "chunk_idx").distinct()
    return chunks.pending_chunks(part(plan), store.results(part)).join(tried, ["job_id", "chunk_idx"], "left_anti").select("job_id", "chunk_idx")


def _called(store: RunStore, run: int, plan: DataFrame, contents: DataFrame, model: Callable, unit_chunks: int, max_parallelism: int | None, sleep: Callable[[float], None], on_unit: Callable[[int, int], None] | None, budget: inference.Budget) -> None:
    """Rounds of units until no planned chunk is without a result that this run has not tried."""
    number = 0
    while True:
        left = _untried(store, run, plan, lambda rows: rows)
        units = -(-left.count() // unit_chunks)
        if not units:
            return
        for k in range(units):
            # what is pending is looked up again for each unit, so that nothing committed meanwhile is called
            part = _unit(k, units)
            own = _untried(store, run, plan, part).join(part(contents), ["job_id", "chunk_idx"], "left").withColumn("content", F.coalesce("content", F.lit(b"")))
            got = inference.transcribe_chunks(own, model, max_parallelism, sleep=sleep, budget=budget)
            store.add("answers", got.select("job_id", "chunk_idx", "text", "error", F.col("attempts").cast("int").alias("attempts"), "errors", F.lit(run).cast("long").alias("run"), F.lit(number).alias("round")))
            if on_unit:
                on_unit(number, k)
        number += 1


def _patches(store: RunStore, run: int, plan: DataFrame, progress: DataFrame) -> DataFrame:
    """A run's checkpoint patch per job: complete, or failed with the error of the first chunk that has no result."""
    errors = store.answers().where((F.col("run") == run) & F.col("text").isNull())
    first = chunks.pending_chunks(plan, store.results()).join(errors, ["job_id", "chunk_idx"]).groupBy("job_id").agg(F.min_by("error", F.struct("chunk_idx", "round")).alias("error"))
    text = lambda c: F.col(c).cast("string")
    rows = progress.join(first, "job_id", "left")
    base = [F.lit("totalChunks"), text("total_chunks")]
    complete = F.create_map(*base, F.lit("status"), F.lit("complete"), F.lit("completedChunks"), text("total_chunks"), F.lit("lastCompletedChunk"), (F.col("total_chunks") - 1).cast("string"), F.lit("currentChunk"), F.lit(None).cast("string"))
    failed = F.create_map(*base, F.lit("status"), F.lit("failed"), F.lit("completedChunks"), text("completed"), F.lit("lastCompletedChunk"), text("last_completed"), F.lit("error"), F.col("error"))
    return rows.select("job_id", F.lit(run).cast("long").alias("seq"), F.when(F.col("error").isNull(), complete).otherwise(failed).alias("patch"))


def transcription_run(submissions: DataFrame, media: DataFrame, contents: DataFrame, model: Callable, store: RunStore, unit_chunks: int = 10_000, max_parallelism: int | None = None, sleep: Callable[[float], None] = time.sleep, on_unit: Callable[[int, int], None] | None = None, seconds: int = chunks.CHUNK_SECONDS, budget: inference.Budget = inference.Budget()) -> DataFrame:
    """Brings every submitted job as far as the model lets it, from what earlier runs have stored; one row per job.

    submissions: (url); media: (job_id, duration_seconds); contents: (job_id, chunk_idx, content binary); job_id is that of
    the trimmed URL. Rows are (job_id, source_url, platform, status, total_chunks, completed_chunks, last_completed_chunk,
    next_resume_chunk, error, transcript).

    Only chunks without a result are called, in units of about ``unit_chunks``, each of which is one Spark job and is committed before
    the next begins. When the run is stopped, by a failure or from outside, the next one goes on from the last unit that was
    committed. A chunk is tried once a run, with the retries of ``inference.with_retry``. Chunks fail apart from each other: a job with
    chunks left is "failed" with the error of the first of them, its other results are kept, and the next run tries again. As
    patches are merged, an error of an earlier run stays in the checkpoint of a job that is complete now. A job without
    a valid duration is planned no chunks: its status is "unknown". ``on_unit`` is called after each commit.
    """
    known, _ = jobs.dedupe_submissions(submissions)
    plan = store.kept_plan(chunks.plan_chunks(media.join(known, "job_id", "left_semi"), seconds))
    run = store.next_run()
    _called(store, run, plan, contents, model, unit_chunks, max_parallelism, sleep, on_unit, budget)
    totals = plan.where("chunk_idx = 0").select("job_id", "total_chunks")
    results = store.results()
    progress = chunks.chunk_progress(totals, results)
    store.add("patches", _patches(store, run, plan, progress))
    folded = jobs.fold_checkpoints(store.patches().join(known, "job_id", "left_semi"), ("status", "error"))
    rows = known.join(progress, "job_id", "left").join(folded, "job_id", "left").join(chunks.rebuild_transcripts(results, totals), "job_id", "left")
    return rows.select(
        "job_id", "source_url", "platform", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"), F.coalesce("completed", F.lit(0)).alias("completed_chunks"),
        F.col("last_completed").alias("last_completed_chunk"), F.col("next_incomplete").alias("next_resume_chunk"), F.coalesce("error", F.lit("")).alias("error"), F.coalesce("transcript", F.lit("")).alias("transcript"),
    )
