"""Outcomes of ordered fall-backs and bounded retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_retryable_error

#: The order of download strategies, and attempts per chunk.
STRATEGIES = ("default", "ipv4", "legacy_tls", "ipv4_no_certificate_check")
MAX_ATTEMPTS, BACKOFF_MS = 3, 1000


def first_success(attempts: DataFrame, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """(job_id, winner, failovers, error) of (job_id, strategy, ok, error): the first strategy that worked.

    Without one: all attempts were failovers and the error is the last strategy's. Unknown strategies are ignored.
    """
    rank = F.array_position(F.array(*map(F.lit, strategies)), F.col("strategy"))
    rows = attempts.withColumn("_rank", rank).where("_rank > 0")
    g = rows.groupBy("job_id").agg(F.min(F.when(F.col("ok"), F.col("_rank"))).alias("w"), F.max(F.struct("_rank", "error")).alias("last"), F.count_distinct("_rank").alias("n"))
    return g.select("job_id", F.when(F.col("w").isNotNull(), F.element_at(F.array(*map(F.lit, strategies)), F.col("w").cast("int"))).alias("winner"), F.coalesce(F.col("w") - 1, F.col("n")).alias("failovers"), F.when(F.col("w").isNull(), F.col("last.error")).alias("error"))


def retry_outcome(attempts: DataFrame, most: int = MAX_ATTEMPTS, backoff_ms: int = BACKOFF_MS) -> DataFrame:
    """(job_id, chunk_idx, attempts, state, backoff_ms) of (job_id, chunk_idx, attempt, error), a null error being a success.

    The first success, error that is not retryable, or ``most``-th attempt ends it; later attempts are ignored. Before
    the n-th retry n * backoff_ms are waited.
    """
    fatal = F.col("error").isNotNull() & ~is_retryable_error(F.col("error"))
    ends = F.col("error").isNull() | fatal | (F.col("attempt") >= most)
    until = F.min(F.when(ends, F.col("attempt"))).over(Window.partitionBy("job_id", "chunk_idx"))
    rows = attempts.withColumn("_end", until).where("_end is null or attempt <= _end")
    last = F.max(F.struct("attempt", "error")).alias("last")
    g = rows.groupBy("job_id", "chunk_idx").agg(F.count("*").alias("attempts"), last, F.max("_end").alias("_end"), F.sum(F.when(F.col("_end").isNull() | (F.col("attempt") < F.col("_end")), F.col("attempt") * backoff_ms)).alias("waited"))
    error = F.col("last.error")
    state = F.when(F.col("_end").isNull(), "in_progress").when(error.isNull(), "ok").when(~is_retryable_error(error), "failed_permanent").otherwise("failed_exhausted")
    return g.select("job_id", "chunk_idx", "attempts", state.alias("state"), F.coalesce("waited", F.lit(0)).cast("long").alias("backoff_ms"))
