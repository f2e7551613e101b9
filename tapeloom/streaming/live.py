"""Structured Streaming twins of the batch operators: event state, checkpoints, streaks and progress."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.jscompat import DAY_MS, js_trim
from ..operators import chunks, jobs, streaks
from ..operators.events import DEFAULT_STEP, UNKNOWN_ERROR
from ..sources.snapshots import Snapshots
from .history import LOWEST, NODE_KEY, NODE_VALUE, ROW_KEY, ROW_VALUE, History, PagedHistory

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "job_id {kind}, message string, progress double, step string, transcript string, transcript_path string, done boolean, error string, last_seq long"


FIELDS = ("last", "message", "progress", "step", "transcript", "transcript_path", "done", "error")


class _Fold(StatefulProcessor):
    """The last value of each field by sequence number, whatever order events come in.

    An error may come after later events have been folded, which then must not count. No watermark bounds how late it can be, so
    values stay, by sequence number; an error drops those after it. Each batch looks up only the last value of each field, see
    ``History``. With ``late``, errors are taken to be at most so many sequence numbers late: of the values before that, each
    field keeps the last, and state stays bounded.
    """

    def __init__(self, late: int | None = None):
        self.late = late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.nodes = handle.getMapState("nodes", NODE_KEY, NODE_VALUE)
        self.rows = handle.getMapState("rows", ROW_KEY, ROW_VALUE)
        self.stop = handle.getValueState("stop", "seq long")

    def _history(self) -> History:
        return History(FIELDS, self.nodes, self.rows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([self._folded(key, (r for pdf in rows for r in pdf.to_dict("records")))])

    def _folded(self, key, rows: Iterable[dict]) -> dict:
        known = stop = held[0] if (held := self.stop.get()) is not None else None
        history = self._history()
        for r in rows:
            seq = int(r["seq"])
            if stop is not None and seq > stop:
                continue
            if r["type"] == "error":
                stop = seq
            history.add(seq, dict(self._values(r)))
        if stop != known:
            self.stop.update((stop,))
            history.drop_after(stop)
        best = {f: s for f in FIELDS if (s := history.last(f)) is not None}
        if self.late is not None and best:
            history.drop_before(max(best["last"] - self.late, LOWEST))  # no error can come up to here any more
        history.flush()
        said = {s: history.at(s) for s in set(best.values())}
        got = lambda f: said[best[f]][f] if f in best else None
        return {
            "job_id": key[0], "message": got("message"), "progress": float(got("progress")) if "progress" in best else None, "step": got("step"), "transcript": got("transcript"),
            "transcript_path": got("transcript_path"), "done": "done" in best, "error": got("error"), "last_seq": best.get("last"),
        }

    @staticmethod
    def _values(r: dict) -> Iterator[tuple[str, str]]:
        there = lambda v: v is not None and v == v
        yield "last", ""
        if there(r["message"]) and r["message"]:
            yield "message", r["message"]
        if there(r["progress"]) or r["type"] == "done":
            yield "progress", repr(100.0 if r["type"] == "done" else min(100.0, max(0.0, float(r["progress"]))))
        if there(r["progress"]):
            yield "step", r["step"] if there(r["step"]) and r["step"] else DEFAULT_STEP
        if there(r["transcript"]):
            yield "transcript", r["transcript"]
        if there(r["transcript_path"]) and r["transcript_path"]:
            yield "transcript_path", r["transcript_path"]
        if r["type"] == "done":
            yield "done", ""
        if r["type"] == "error":
            yield "error", r["error"] if there(r["error"]) and r["error"] else UNKNOWN_ERROR

    def close(self) -> None:
        pass


class _PagedFold(_Fold):
    """The same with many values in one entry of the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", NODE_KEY, NODE_VALUE)
        self.stop = handle.getValueState("stop", "seq long")

    def _history(self) -> History:
        return PagedHistory(FIELDS, self.pages)


class _RowFold(_PagedFold):
    """The same on rows: a frame for each job and batch, in and out, takes longer than the job's few events."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield Row(**self._folded(key, (r.asDict() for r in rows)))


def stream_job_state(events: DataFrame, late: int | None = None) -> DataFrame:
    """fold_events over a stream, in update mode: a row for each job that a batch touches. Needs the RocksDB state store.

    Exact for any order of events. State holds the values seen, which ``late`` bounds; the work of a batch does not grow with them.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    want = {"type": "string", "step": "string", "message": "string", "progress": "double", "transcript": "string", "transcript_path": "string", "error": "string"}
    rows = events.select("job_id", "seq", *(F.col(c) if c in events.columns else F.lit(None).cast(t).alias(c) for c, t in want.items()))
    kind = events.schema["job_id"].dataType.simpleString()
    return rows.groupBy("job_id").transformWithState(_RowFold(late), OUT.format(kind=kind), "update", "None")


def stream_checkpoints(patches: DataFrame) -> DataFrame:
    """(job_id, key, value, seq) of the last value of each key, as a streaming aggregate in update mode; state grows with keys only."""
    rows = patches.select("job_id", "seq", F.explode("patch").alias("key", "value"))
    last = rows.groupBy("job_id", "key").agg(F.max(F.struct("seq", F.struct("value").alias("v"))).alias("m"))
    return last.select("job_id", "key", F.col("m.v.value").alias("value"), F.col("m.seq").alias("seq"))


def _upserted(stream: DataFrame, store: Snapshots, checkpoint: str, mode: str, available_now: bool, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, bits: tuple[str, ...] = ()) -> StreamingQuery:
    """Commits each batch to a table at once; a batch that is repeated after a failure changes nothing."""

    def batch(df: DataFrame, number: int) -> None:
        store.upsert(prepare(df), checkpoint, number, bits)

    writer = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def upsert_checkpoints(patches: DataFrame, store: Snapshots, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps the last value of each key of each job in ``store`` (keys job_id and key, order seq), from patches (job_id, seq, patch).

    A batch writes the entries it has; whether they are the last is settled by their numbers, so batches may come repeated and in
    any order, and the stream itself holds no state.
    """
    return _upserted(patches, store, checkpoint, "append", available_now, jobs.checkpoint_entries)


class _Streaks(StatefulProcessor):
    """A user's relapses in order, and how many completed streaks of each length there are, both looked up by range.

    A relapse ends the streak that it falls in and begins another, so it changes two lengths, however late it comes.
    """

    def __init__(self, now_ms: int):
        self.now = now_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at_nodes = handle.getMapState("at_nodes", NODE_KEY, NODE_VALUE)
        self.at_rows = handle.getMapState("at_rows", ROW_KEY, ROW_VALUE)
        self.length_nodes = handle.getMapState("length_nodes", NODE_KEY, NODE_VALUE)
        self.length_rows = handle.getMapState("length_rows", ROW_KEY, ROW_VALUE)
        self.count = handle.getValueState("count", "started long, n long")

    def _histories(self) -> tuple[History, History]:
        return History(("at",), self.at_nodes, self.at_rows), History(("n",), self.length_nodes, self.length_rows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([self._counted(key, (r for pdf in rows for r in zip(pdf["ts_ms"].tolist(), pdf["started_ms"].tolist())))])

    def _counted(self, key, rows: Iterable[tuple]) -> dict:
        started, n = held if (held := self.count.get()) is not None else (None, 0)
        at, lengths = self._histories()

        def change(length: int, by: int) -> None:
            held = lengths.at(length).get("n", 0) + by
            if held:
                lengths.add(length, {"n": held})
            else:
                lengths.drop("n", length)

        for ts, start in rows:
            started = int(start) if started is None else started
            if ts != ts or ts is None or not started < int(ts) <= self.now:
                continue
            ts = int(ts)
            before = at.last("at", ts)
            if before == ts:
                continue
            begin, end = started if before is None else before, at.first("at", ts)
            if end is not None:
                change(end - begin, -1)
                change(end - ts, 1)
            change(ts - begin, 1)
            at.add(ts, {"at": 1})
            n += 1
        at.flush()
        lengths.flush()
        self.count.update((started, n))
        last = at.last("at")
        current = max(0, self.now - (started if last is None else last))
        best = lengths.last("n")
        return {"user_id": key[0], "relapse_count": n, "current_ms": current, "best_ms": max(current, best or 0), "total_ms": max(0, self.now - started)}

    def close(self) -> None:
        pass


class _PagedStreaks(_Streaks):
    """The same with many relapses, or lengths, in one entry of the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at_pages = handle.getMapState("at_pages", NODE_KEY, NODE_VALUE)
        self.length_pages = handle.getMapState("length_pages", NODE_KEY, NODE_VALUE)
        self.count = handle.getValueState("count", "started long, n long")

    def _histories(self) -> tuple[History, History]:
        return PagedHistory(("at",), self.at_pages), PagedHistory(("n",), self.length_pages)


class _RowStreaks(_PagedStreaks):
    """The same on rows, as ``_RowFold``."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield Row(**self._counted(key, ((r["ts_ms"], r["started_ms"]) for r in rows)))


def stream_streak_stats(relapses: DataFrame, users: DataFrame, now_ms: int) -> DataFrame:
    """streak_stats over a stream of relapses (user_id, ts_ms), in update mode: a row for each user that a batch touches.

    Exact for relapses in any order, repeated ones included. A batch's work follows the rows it has, not the relapses that
    their users have had. users (user_id, started_ms) is a table; relapses of others are left out. Needs the RocksDB state store.
    """
    relapses.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = relapses.schema["user_id"].dataType.simpleString()
    rows = relapses.select("user_id", "ts_ms").join(users.select("user_id", "started_ms"), "user_id")
    held = rows.groupBy("user_id").transformWithState(_RowStreaks(now_ms), f"user_id {kind}, relapse_count long, current_ms long, best_ms long, total_ms long", "update", "None")
    day = F.lit(float(DAY_MS))
    raw = held.select("user_id", "relapse_count", *((F.col(f"{c}_ms") / day).alias(f"{c}_days") for c in ("current", "best")), (F.col("total_ms") / day / (F.col("relapse_count") + 1)).alias("avg_days"))
    return streaks.labelled(raw)  # streaks tile the time from the start to now, so their mean needs their number only


def stream_streaks(relapses: DataFrame, users: DataFrame, now_ms: int, store: Snapshots, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps stream_streak_stats' rows in ``store`` (key user_id)."""
    return _upserted(stream_streak_stats(relapses, users, now_ms), store, checkpoint, "update", available_now)


class _Texts(StatefulProcessor):
    """A job's latest text per chunk."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.texts = handle.getMapState("texts", "chunk_idx int", "text string, at string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = {k[0]: (v[1], v[0]) for k, v in self.texts.iterator()}  # all are the result's, so none is looked up by itself
        new: dict[int, tuple[str, str]] = {}
        for r in rows:
            idx, value = int(r["chunk_idx"]), (r["at"] or "", r["text"] or "")
            if (known := new.get(idx, held.get(idx))) is None or known < value:
                new[idx] = value
        for idx, (at, text) in new.items():
            self.texts.updateValue((idx,), (text, at))
        yield Row(job_id=key[0], texts=[Row(chunk_idx=k, text=text) for k, (_, text) in sorted((held | new).items())])

    def close(self) -> None:
        pass


def stream_transcripts(results: DataFrame, totals: DataFrame) -> DataFrame:
    """chunk_progress and rebuild_transcripts over a stream of results (job_id, chunk_idx, text, ingest_ts), in update mode.

    A row (job_id, total_chunks, completed, last_completed, next_incomplete, transcript) for each job that a batch touches. The
    latest result of a chunk counts, of equal times the greatest text. A batch reads the texts of the jobs it touches, since
    their transcripts are its result; where counts do, stream_chunk_words reads none. Needs the RocksDB state store.
    """
    results.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = results.schema["job_id"].dataType.simpleString()
    rows = results.select("job_id", F.col("chunk_idx").cast("int").alias("chunk_idx"), "text", F.date_format("ingest_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))
    held = rows.groupBy("job_id").transformWithState(_Texts(), f"job_id {kind}, texts array<struct<chunk_idx int, text string>>", "update", "None")
    known = held.join(totals.select("job_id", F.coalesce("total_chunks", F.lit(0)).cast("int").alias("total_chunks")), "job_id")
    total = F.col("total_chunks")
    trimmed = F.transform("texts", lambda r: F.struct(r["chunk_idx"].alias("chunk_idx"), js_trim(r["text"]).alias("text")))
    known = known.withColumn("texts", F.filter(trimmed, lambda r: r["text"] != ""))
    completed, last, following = chunks.text_counts(F.col("texts"), total)
    own = F.filter("texts", lambda r: r["chunk_idx"] < total)
    return known.select("job_id", "total_chunks", completed.alias("completed"), last.alias("last_completed"), following.alias("next_incomplete"), chunks.transcript_of(own).alias("transcript"))


def stream_progress(results: DataFrame, totals: DataFrame, store: Snapshots, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps stream_transcripts' rows in ``store`` (key job_id)."""
    return _upserted(stream_transcripts(results, totals), store, checkpoint, "update", available_now)


def stream_chunk_words(results: DataFrame, store: Snapshots, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps which chunks of each job are done in ``store`` (keys job_id and word), as chunks.chunk_words: 64 chunks a number.

    A chunk that was done stays done. chunks.word_progress gives the counts of any set of jobs. A batch writes the numbers of its own
    results, which the store merges by bit_or, so batches may come repeated and in any order, and the stream itself holds no state.
    """
    return _upserted(results, store, checkpoint, "append", available_now, chunks.chunk_words, ("bits",))
