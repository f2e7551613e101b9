"""Jobs: checkpoints, status, submissions, look-ups and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.jscompat import first_truthy, js_trim
from .chunks import ordered_texts, text_counts, transcript_of

CHECKPOINT_KEYS = ("status", "sourceUrl", "title", "totalChunks", "completedChunks", "currentChunk", "lastCompletedChunk", "error", "lastChunkError", "transcribeAttempt", "updatedAt")


def checkpoint_entries(patches: DataFrame) -> DataFrame:
    """(job_id, key, value, seq): the last value of each key; an explicit null overwrites, an absent key does not."""
    rows = patches.select("job_id", "seq", F.explode("patch").alias("key", "value"))
    last = rows.groupBy("job_id", "key").agg(F.max(F.struct("seq", F.struct("value").alias("v"))).alias("m"))
    return last.select("job_id", "key", F.col("m.v.value").alias("value"), F.col("m.seq").alias("seq"))


def fold_checkpoints(patches: DataFrame, keys: tuple[str, ...] = CHECKPOINT_KEYS) -> DataFrame:
    """One row per job with the folded value of each known key as text."""
    picked = [F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys]
    return checkpoint_entries(patches).groupBy("job_id").agg(*picked)


def job_status(jobs: DataFrame, checkpoints: DataFrame, metadata: DataFrame, manifests: DataFrame, results: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """One row per job of ``jobs`` (job_id): defaults and fall-backs as a status page shows them.

    Counts and, without ``transcripts``, the transcript come from one aggregate of the results, which are read once.

    checkpoints: columns of fold_checkpoints; metadata: (job_id, source_url, title, updated_at); manifests: (job_id,
    total_chunks); results: (job_id, chunk_idx, text), one per chunk; transcripts: (job_id, transcript).
    """
    c = checkpoints.select("job_id", *(F.col(k).alias(f"c_{k}") for k in CHECKPOINT_KEYS if k in checkpoints.columns), *(F.lit(None).cast("string").alias(f"c_{k}") for k in CHECKPOINT_KEYS if k not in checkpoints.columns))
    m = metadata.select("job_id", F.col("source_url").alias("m_url"), F.col("title").alias("m_title"), F.col("updated_at").alias("m_updated"))
    f = manifests.select("job_id", F.col("total_chunks").alias("f_total"))
    base = jobs.select("job_id").join(c, "job_id", "left").join(m, "job_id", "left").join(f, "job_id", "left")
    number = lambda k: F.col(k).try_cast("int")
    base = base.withColumn("total_chunks", F.coalesce(F.nullif(number("c_totalChunks"), F.lit(0)), F.nullif(F.col("f_total"), F.lit(0)), F.lit(0)))
    out = base.join(ordered_texts(results), "job_id", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<struct<chunk_idx:int,text:string>>")))
    if transcripts is None:
        out = out.withColumn("transcript_preview", S.transcript_preview(transcript_of(F.col("texts"))))
    else:
        out = out.join(transcripts.select("job_id", S.transcript_preview(F.coalesce("transcript", F.lit(""))).alias("transcript_preview")), "job_id", "left")
    completed, last, following = text_counts(F.col("texts"), F.col("total_chunks"))
    out = out.withColumns({"completed": completed, "last_completed": last, "next_incomplete": following}).drop("texts")
    text = lambda *ks: F.coalesce(first_truthy(*(F.col(k) for k in ks)), F.lit(""))
    current = number("c_currentChunk")
    return out.select(
        "job_id", text("c_sourceUrl", "m_url").alias("source_url"), text("c_title", "m_title").alias("title"),
        F.coalesce(first_truthy(F.col("c_status")), F.lit("unknown")).alias("status"), "total_chunks", F.col("completed").alias("completed_chunks"),
        current.alias("current_chunk"), (current + 1).alias("current_chunk_human"), F.col("last_completed").alias("last_completed_chunk"), (F.col("last_completed") + 1).alias("last_completed_chunk_human"),
        F.col("next_incomplete").alias("next_resume_chunk"), (F.col("next_incomplete") + 1).alias("next_resume_chunk_human"),
        S.progress_pct(F.col("completed"), F.col("total_chunks")).alias("progress"), F.coalesce("transcript_preview", F.lit("")).alias("transcript_preview"),
        text("c_error").alias("error"), text("c_lastChunkError").alias("last_chunk_error"), text("c_updatedAt", "m_updated").alias("updated_at"),
    )


def job_summary(status: DataFrame) -> DataFrame:
    """Labels of a status row: done/total, what is next, and whether the transcript can be had."""
    total, done = F.col("total_chunks"), F.col("completed_chunks")
    return status.select("job_id", F.concat_ws("/", done.cast("string"), total.cast("string")).alias("summary"), S.job_summary_label(F.col("next_resume_chunk_human"), total, done, F.col("current_chunk_human")).alias("next"), S.downloadable(done, total).alias("downloadable"))


def dedupe_submissions(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs (job_id, source_url, platform), one per distinct trimmed URL, and rejected rows (url, reason)."""
    checked = urls.select("url", S.validate_submission(F.col("url")).alias("v"))
    jobs = checked.where("v.reason is null").groupBy(S.job_id(F.col("v.url")).alias("job_id")).agg(F.min("v.url").alias("source_url"))
    return jobs.select("job_id", "source_url", S.detect_platform(F.col("source_url")).alias("platform")), checked.where("v.reason is not null").select("url", F.col("v.reason").alias("reason"))


def requested_job(job_id: Column, url: Column) -> Column:
    """The job a request means: its job id if given (null if that is invalid, the URL does not count then), else its URL's."""
    given, link = js_trim(F.coalesce(job_id, F.lit(""))), js_trim(F.coalesce(url, F.lit("")))
    return F.when(given != "", F.when(S.is_valid_job_id(given), given)).when(link != "", S.job_id(link))


def locate_job(requests: DataFrame, jobs: DataFrame, none_code: int = 400) -> DataFrame:
    """Requests (…, job_id, url) with found_job_id and an outcome code: 200, ``none_code`` if none is meant, 404 if unknown."""
    wanted = requests.withColumn("_job", requested_job(F.col("job_id"), F.col("url")))
    known = jobs.select(F.col("job_id").alias("_known")).distinct()
    out = wanted.join(known, wanted["_job"] == known["_known"], "left")
    code = F.when(F.col("_job").isNull(), none_code).when(F.col("_known").isNull(), 404).otherwise(200)
    return out.select(*requests.columns, F.col("_known").alias("found_job_id"), code.alias("code"))


def qa_requests(questions: DataFrame, transcripts: DataFrame, metadata: DataFrame, model: str = "chat") -> DataFrame:
    """(question_id, job_id, code, prompt): 400 for a blank question, 404 without a job or transcript, 400 for a blank one.

    questions: (question_id, question, job_id, url); transcripts: (job_id, transcript), null or absent if there is none;
    metadata: (job_id, title, source_url).
    """
    question = js_trim(F.coalesce(F.col("question"), F.lit("")))
    # each of these columns is used more than once, so it is computed in a projection of its own
    asked = questions.select("question_id", question.alias("question"), js_trim(F.coalesce("url", F.lit(""))).alias("url"), requested_job(F.col("job_id"), F.col("url")).alias("job_id"))
    out = asked.join(transcripts.select("job_id", js_trim(F.col("transcript")).alias("transcript")), "job_id", "left").join(metadata.select("job_id", "title", "source_url"), "job_id", "left")
    code = F.when(F.col("question") == "", 400).when(F.col("transcript").isNull(), 404).when(F.col("transcript") == "", 400).otherwise(200)
    prompt = S.build_qa_prompt(F.col("title"), first_truthy(F.col("source_url"), F.col("url")), F.col("transcript"), F.col("question"), model)
    return out.select("question_id", "job_id", code.alias("code"), F.when(code == 200, prompt).alias("prompt"))
