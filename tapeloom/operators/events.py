"""Progress event logs: the newest lines and the final state per job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp_progress

LOG_LINES = 8
#: What the page says.
DEFAULT_STEP, UNKNOWN_ERROR = "处理中", "未知错误"


def recent_log(events: DataFrame, n: int = LOG_LINES) -> DataFrame:
    """(job_id, rank, seq, message): each job's newest n messages that are not empty."""
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq")))
    rows = events.where("message is not null and message <> ''").select("job_id", "seq", "message", rank.alias("rank"))
    return rows.where(F.col("rank") <= n).select("job_id", "rank", "seq", "message")


def fold_events(events: DataFrame) -> DataFrame:
    """One row per job: the last state of each field up to the first error, after which the reader has stopped.

    The last message and transcript path that are not empty, the last progress (clamped; done is 100) with its step, the last
    transcript, an empty one included, and the error. Columns that events lack read as null.
    """
    want = {"type": "string", "step": "string", "message": "string", "progress": "double", "transcript": "string", "transcript_path": "string", "error": "string"}
    rows = events.select("job_id", "seq", *(F.col(c) if c in events.columns else F.lit(None).cast(t).alias(c) for c, t in want.items()))
    # the least error is found before the shuffle, so a hot job is no window in one task
    stop = rows.where("type = 'error'").groupBy("job_id").agg(F.min("seq").alias("_stop"))
    rows = rows.join(stop, "job_id", "left").where("_stop is null or seq <= _stop")
    done = F.col("type") == "done"
    last = lambda value, when: F.max(F.when(when, F.struct(F.col("seq"), F.struct(value.alias("x")).alias("v"))))["v"]["x"]
    progress = F.when(done, F.lit(100.0)).otherwise(clamp_progress(F.col("progress")))
    has = F.col("progress").isNotNull()
    return rows.groupBy("job_id").agg(
        last(F.col("message"), F.coalesce(F.col("message") != "", F.lit(False))).alias("message"),
        last(progress, has | F.coalesce(done, F.lit(False))).alias("progress"),
        last(F.coalesce(F.nullif("step", F.lit("")), F.lit(DEFAULT_STEP)), has).alias("step"),
        last(F.col("transcript"), F.col("transcript").isNotNull()).alias("transcript"),
        last(F.col("transcript_path"), F.coalesce(F.col("transcript_path") != "", F.lit(False))).alias("transcript_path"),
        F.coalesce(F.bool_or(done), F.lit(False)).alias("done"),
        last(F.coalesce(F.nullif("error", F.lit("")), F.lit(UNKNOWN_ERROR)), F.coalesce(F.col("type") == "error", F.lit(False))).alias("error"),
        F.max("seq").alias("last_seq"),
    )
