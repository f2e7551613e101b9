"""Chunk planning, resuming, progress, transcripts and manifests per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.jscompat import is_blank, js_trim

CHUNK_SECONDS = 120


def plan_chunks(durations: DataFrame, seconds: int = CHUNK_SECONDS) -> DataFrame:
    """(job_id, chunk_idx, start_s, end_s, total_chunks, single_file) of (job_id, duration_seconds); one chunk up to ``seconds``.

    A job without a valid duration has no chunks.
    """
    d = F.col("duration_seconds")
    n = F.when(d <= seconds, 1).otherwise(F.ceil(d / seconds)).cast("int")
    rows = durations.where(S.is_valid_media(d)).select("job_id", "duration_seconds", n.alias("total_chunks"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)).alias("chunk_idx"))
    start = (F.col("chunk_idx") * seconds).cast("double")
    return rows.select("job_id", "chunk_idx", start.alias("start_s"), F.least(start + seconds, d).alias("end_s"), "total_chunks", (d <= seconds).alias("single_file"))


def plan_from_totals(totals: DataFrame) -> DataFrame:
    """(job_id, chunk_idx, total_chunks) of (job_id, total_chunks)."""
    return totals.where("total_chunks > 0").select("job_id", F.explode(F.sequence(F.lit(0), F.col("total_chunks").cast("int") - 1)).alias("chunk_idx"), "total_chunks")


def latest_result(results: DataFrame, *order: Column) -> DataFrame:
    """One row per (job_id, chunk_idx), the last by ``order`` (default ingest_ts, of equal times the greatest text): a later result overwrites."""
    newest = Window.partitionBy("job_id", "chunk_idx").orderBy(*(order or (F.desc("ingest_ts"), F.desc("text"))))
    return results.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def pending_chunks(plan: DataFrame, results: DataFrame, blank_is_done: bool = True) -> DataFrame:
    """Planned chunks without a result. By default a result of only white space counts as one, as resuming has it."""
    text = F.col("text")
    done = results.where(F.coalesce(text != "", F.lit(False)) if blank_is_done else ~is_blank(text))
    return plan.join(done.select("job_id", "chunk_idx"), ["job_id", "chunk_idx"], "left_anti")


def chunk_progress(totals: DataFrame, results: DataFrame) -> DataFrame:
    """(job_id, total_chunks, completed, last_completed, next_incomplete) of every job in (job_id, total_chunks).

    With a total, results from it on do not count. Without one (null or 0) all results count and nothing is next. One
    grouped pass: the least index not completed is found by windows over the completed ones, no plan rows are made.
    """
    total = F.coalesce(F.col("total_chunks"), F.lit(0)).cast("int")
    done = results.where(~is_blank(F.col("text"))).select("job_id", F.col("chunk_idx").cast("int").alias("chunk_idx")).distinct()
    joined = totals.select("job_id", total.alias("total_chunks")).join(done, "job_id", "left")
    counted = F.col("chunk_idx").isNotNull() & ((F.col("total_chunks") == 0) | (F.col("chunk_idx") < F.col("total_chunks")))
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.asc_nulls_last("chunk_idx"))) - 1
    g = joined.withColumn("_in", counted).withColumn("_gap", (place < F.col("chunk_idx")) & counted).withColumn("_place", place)
    g = g.groupBy("job_id").agg(F.first("total_chunks").alias("total_chunks"), F.count(F.when(F.col("_in"), 1)).alias("completed"), F.max(F.when(F.col("_in"), F.col("chunk_idx"))).alias("last_completed"), F.min(F.when(F.col("_gap"), F.col("_place"))).alias("_first"))
    upto = F.coalesce(F.col("_first"), F.col("completed").cast("int"))
    return g.select("job_id", "total_chunks", "completed", "last_completed", F.when((F.col("total_chunks") > 0) & (upto < F.col("total_chunks")), upto).alias("next_incomplete"))


def completed_chunks(totals: DataFrame, results: DataFrame) -> DataFrame:
    return chunk_progress(totals, results).select("job_id", "completed")


def last_completed_chunk(totals: DataFrame, results: DataFrame) -> DataFrame:
    return chunk_progress(totals, results).select("job_id", "last_completed")


def next_incomplete_chunk(totals: DataFrame, results: DataFrame) -> DataFrame:
    return chunk_progress(totals, results).select("job_id", "next_incomplete")


def rebuild_transcripts(results: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """(job_id, transcript): chunks that are not blank in order, each under its number; gaps keep their numbers.

    ``totals`` (job_id, total_chunks) bounds the chunks. Jobs without such chunks have an empty transcript if they have results.
    """
    rows = results.select("job_id", F.col("chunk_idx").cast("int").alias("chunk_idx"), js_trim(F.col("text")).alias("text"))
    if totals is not None:
        rows = rows.join(totals.select("job_id", "total_chunks"), "job_id").where("chunk_idx < total_chunks")
    kept = F.when(F.coalesce(F.col("text") != "", F.lit(False)), F.struct("chunk_idx", "text"))
    return rows.groupBy("job_id").agg(transcript_of(F.sort_array(F.collect_list(kept))).alias("transcript"))


def transcript_of(texts: Column) -> Column:
    """The transcript of an ordered array of (chunk_idx, text), trimmed and none blank."""
    parts = F.transform(texts, lambda r: F.concat(F.lit("## Chunk "), (r["chunk_idx"] + 1).cast("string"), F.lit("\n\n"), r["text"]))
    return js_trim(F.array_join(parts, "\n\n"))


def ordered_texts(results: DataFrame) -> DataFrame:
    """(job_id, texts): each job's chunks that are not blank, trimmed and in order, of results with one row per chunk."""
    kept = F.struct(F.col("chunk_idx").cast("int").alias("chunk_idx"), js_trim(F.col("text")).alias("text"))
    return results.where(~is_blank(F.col("text"))).groupBy("job_id").agg(F.sort_array(F.collect_list(kept)).alias("texts"))


def text_counts(texts: Column, total: Column) -> tuple[Column, Column, Column]:
    """completed, last_completed and next_incomplete, as chunk_progress has them, of ordered_texts' array and a total (0: unknown)."""
    done = F.transform(F.filter(texts, lambda r: (total == 0) | (r["chunk_idx"] < total)), lambda r: r["chunk_idx"])
    missing = F.array_min(F.array_except(F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0))), done))
    return F.size(done).cast("long"), F.array_max(done), F.when(total > 0, missing)


def chunk_words(results: DataFrame) -> DataFrame:
    """(job_id, word, bits): which chunks of a job have a result that is not blank, 64 chunks a number.

    Numbers of the same word merge by bit_or, in any order and however often: one aggregate with map-side combination, no
    window and no sort. It may run on a stream, too.
    """
    idx = F.col("chunk_idx").cast("int")
    rows = results.where(~is_blank(F.col("text")) & (idx >= 0)).select("job_id", F.floor(idx / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(chunk_idx as int) % 64)").alias("bit"))
    return rows.groupBy("job_id", "word").agg(F.bit_or("bit").alias("bits"))


def word_progress(totals: DataFrame, words: DataFrame) -> DataFrame:
    """chunk_progress of (job_id, total_chunks) from ``chunk_words``: completed is a count of bits, last the highest, next the first that is not set.

    A job's words are as many as its chunks by 64, and come together as one array.
    """
    total = F.coalesce(F.col("total_chunks"), F.lit(0)).cast("int")
    held = words.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    rows = totals.select("job_id", total.alias("total_chunks")).join(held, "job_id", "left")
    # of the word that the total falls in, the bits below it count
    room = lambda w: F.col("total_chunks") - w["word"] * 64
    below = lambda n: F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - n)
    own = lambda w: F.when((F.col("total_chunks") == 0) | (room(w) >= 64), w["bits"]).when(room(w) > 0, w["bits"].bitwiseAND(below(room(w)))).otherwise(F.lit(0).cast("long"))
    kept = F.filter(F.transform(F.coalesce("words", F.array().cast("array<struct<word:int,bits:bigint>>")), lambda w: F.struct(w["word"].alias("word"), own(w).alias("bits"))), lambda w: w["bits"] != 0)
    rows = rows.withColumn("words", kept)
    top = F.element_at("words", -1)
    high = 63 - F.length(F.regexp_extract(F.lpad(F.bin(top["bits"]), 64, "0"), "^0*", 0))
    completed = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w["bits"]))
    # words in order: the first gap is in the first one that is missing or whose bits are not all set
    ones = lambda bits: F.length(F.regexp_extract(F.bin(bits), "1*$", 0))
    first = F.aggregate("words", F.lit(0), lambda n, w: F.when(n == w["word"] * 64, n + ones(w["bits"])).otherwise(n))
    rows = rows.select("job_id", "total_chunks", completed.alias("completed"), F.when(F.size("words") > 0, top["word"] * 64 + high).alias("last_completed"), first.alias("_first"))
    return rows.select("job_id", "total_chunks", "completed", "last_completed", F.when((F.col("total_chunks") > 0) & (F.col("_first") < F.col("total_chunks")), F.col("_first")).alias("next_incomplete"))


def build_manifest(files: DataFrame, durations: DataFrame, kind: str = "video", seconds: int = CHUNK_SECONDS) -> DataFrame:
    """One manifest per job of files (job_id, file_name, duration_seconds) and (job_id, duration_seconds).

    A job within one chunk names its own single file. A job without files, or with an invalid one, has no manifest.
    """
    found = files.groupBy("job_id").agg(F.sort_array(F.collect_list("file_name")).alias("chunks"), F.bool_and(S.is_valid_media(F.col("duration_seconds"))).alias("valid"))
    rows = durations.join(found, "job_id").where("valid")
    single = F.col("duration_seconds") <= seconds
    return rows.select("job_id", F.lit(kind).alias("kind"), F.size("chunks").alias("total_chunks"), F.lit(seconds).alias("chunk_seconds"), "duration_seconds", "chunks", single.alias("single_file"))


def reusable_manifests(manifests: DataFrame, probes: DataFrame, files: DataFrame, kind: str = "video", seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Manifests that still fit their job: same kind and chunk length, duration within 1 s of the probe's, and every named file is there and valid.

    probes: (job_id, probe_seconds); files: (job_id, file_name, duration_seconds).
    """
    d = F.col("duration_seconds")
    ok = (F.col("kind") == kind) & (F.col("chunk_seconds") == seconds) & (F.abs(d - F.col("probe_seconds")) <= 1) & ~F.isnan(d) & (F.abs(d) < float("inf")) & (F.size("chunks") > 0) & (F.size("chunks") == F.col("total_chunks"))
    fits = manifests.join(probes, "job_id").where(ok).drop("probe_seconds")
    named = fits.select("job_id", F.explode("chunks").alias("file_name")).withColumn("file_name", F.regexp_extract("file_name", r"([^/]*)/*$", 1)).distinct()
    valid = files.where(S.is_valid_media(d)).select("job_id", "file_name").distinct()
    lacking = named.join(valid, ["job_id", "file_name"], "left_anti").select("job_id").distinct()
    return fits.join(lacking, "job_id", "left_anti")


def final_checkpoint(totals: DataFrame, results: DataFrame) -> DataFrame:
    """What is stored when a run ends: complete with all chunks, and whether that was forced over blank ones."""
    p = chunk_progress(totals, results)
    return p.select("job_id", F.lit("complete").alias("status"), "total_chunks", F.col("total_chunks").alias("completed_chunks"), (F.col("total_chunks") > F.col("completed")).alias("forced_complete"))
