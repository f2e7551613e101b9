"""Batch model calls over pending chunks and questions, with bounded retries. The model is any callable."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.responses import require_text, route_response
from ..functions.scalars import RETRYABLE
from .attempts import BACKOFF_MS, MAX_ATTEMPTS


def with_retry(call: Callable, most: int = MAX_ATTEMPTS, backoff_ms: int = BACKOFF_MS, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call(x) as a function that returns (value or None, list of errors), one error for each failed attempt."""

    def run(x):
        errors: list[str] = []
        while True:
            try:
                return call(x), errors
            except Exception as e:  # noqa: BLE001 what the model raises is data here
                errors.append(str(e))
                if len(errors) >= most or not re.search(RETRYABLE, errors[-1]):
                    return None, errors
                sleep(len(errors) * backoff_ms / 1000)

    return run


class Pace:
    """At most ``rate`` calls a second by the clock, in order, whichever threads they come from; a burst is spread out."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep = 1 / rate, clock, sleep
        self.lock, self.free = threading.Lock(), float("-inf")

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            at = max(now, self.free)
            self.free = at + self.gap
        if at > now:
            self.sleep(at - now)

    def paced(self, call: Callable) -> Callable:
        def run(x):
            self.wait()
            return call(x)

        return run


@dataclass(frozen=True)
class Budget:
    """How hard the model may be called: ``calls_per_second`` over all tasks, and ``at_a_time`` calls in a task.

    The rate is shared out over the tasks that can run side by side (max_parallelism), retries included. A task calls its rows
    concurrently, in order of their slots, so slow answers don't keep the rate from being used.
    """

    calls_per_second: float | None = None
    at_a_time: int = 1


def _answers(rows: DataFrame, keys: list[str], payload: str, model: Callable, max_parallelism: int | None, fail_fast: bool, sleep, budget: Budget = Budget()) -> DataFrame:
    if budget.calls_per_second and not max_parallelism:
        raise ValueError("a rate is shared over max_parallelism tasks")
    fields = [rows.schema[k] for k in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", raw string, content_type string, errors array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Pace(budget.calls_per_second / max_parallelism).paced(model) if budget.calls_per_second else model
        call = with_retry(own, sleep=sleep)
        for pdf in batches:
            if budget.at_a_time > 1:
                with ThreadPoolExecutor(budget.at_a_time) as pool:
                    got = list(pool.map(call, pdf[payload]))
            else:
                got = [call(x) for x in pdf[payload]]
            if fail_fast and any(v is None for v, _ in got):
                raise RuntimeError(next(e[-1] for v, e in got if v is None))
            pairs = [v if isinstance(v, tuple) else (v, "") for v, _ in got]
            yield pdf[keys].assign(raw=[p[0] for p in pairs], content_type=[p[1] for p in pairs], errors=[e for _, e in got])

    dealt = rows.select(*keys, payload)
    dealt = dealt.repartition(max_parallelism, *keys) if max_parallelism else dealt.repartition(*keys)
    called = dealt.mapInPandas(run, schema)
    answer = require_text(route_response(F.col("content_type"), F.col("raw")))
    failed = F.col("raw").isNull()
    return called.select(*keys, F.when(~failed, answer["text"]).alias("text"), F.when(failed, F.element_at("errors", -1)).otherwise(answer["error"]).alias("error"), (F.size("errors") + F.when(failed, 0).otherwise(1)).alias("attempts"), "errors")


def transcribe_chunks(pending: DataFrame, model: Callable, max_parallelism: int | None = None, fail_fast: bool = False, sleep: Callable[[float], None] = time.sleep, budget: Budget = Budget()) -> DataFrame:
    """(job_id, chunk_idx, text, error, attempts, errors) of (job_id, chunk_idx, content): model(content) gives the raw response.

    Chunks are independent, so partitions run side by side; ``max_parallelism`` bounds the tasks at a time, ``budget`` the calls a
    second and at a time. A failed chunk is a row with an error, unless ``fail_fast``. A repeated task repeats its calls; results are
    keyed by chunk, the latest counts. runs.transcription_run commits bounded units, so that little is repeated.
    """
    return _answers(pending, ["job_id", "chunk_idx"], "content", model, max_parallelism, fail_fast, sleep, budget)


def answer_questions(requests: DataFrame, model: Callable, max_parallelism: int | None = None, fail_fast: bool = False, sleep: Callable[[float], None] = time.sleep, budget: Budget = Budget()) -> DataFrame:
    """(question_id, text, error, attempts, errors) of requests with code 200: model(prompt) gives the raw response."""
    return _answers(requests.where("code = 200"), ["question_id"], "prompt", model, max_parallelism, fail_fast, sleep, budget)


def attempt_rows(results: DataFrame) -> DataFrame:
    """(job_id, chunk_idx, attempt, error): the attempts behind transcribe_chunks' rows, as retry_outcome reads them."""
    failed = results.select("job_id", "chunk_idx", F.posexplode("errors").alias("attempt", "error")).withColumn("attempt", F.col("attempt") + 1)
    ok = results.where(F.size("errors") < F.col("attempts")).select("job_id", "chunk_idx", F.col("attempts").alias("attempt"), F.lit(None).cast("string").alias("error"))
    return failed.unionByName(ok)
