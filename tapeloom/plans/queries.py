"""The registered queries: each applies operators to whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import responses as P
from ..functions import scalars as S
from ..functions.jscompat import js_trim
from ..operators import attempts as A
from ..operators import chunks as C
from ..operators import events as E
from ..operators import inference as I
from ..operators import jobs as J
from ..operators import runs as U
from ..operators import streaks as K
from ..sources import readers as R
from ..sources import writers as W
from ..sources.snapshots import Snapshots
from ..streaming import live as L
from . import views as V
from .scratch import shared_path

NOW = V.NOW_MS
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _streaks(s, d):
    return K.build_streaks(V.relapses(s, d), V.streak_users(s, d), NOW)


@query
def streak_stats(s: SparkSession, d: str) -> DataFrame:
    return K.streak_stats(_streaks(s, d))


@query
def streak_normalize(s, d):
    return K.normalize_relapses(V.relapses(s, d), V.streak_users(s, d), NOW)


@query
def streaks(s, d):
    return _streaks(s, d)


@query
def progress_points(s, d):
    return K.progress_points(_streaks(s, d))


@query
def streak_report(s, d):
    r = K.streak_report(_streaks(s, d), NOW)
    rows = r.select("user_id", "current_label", F.size("relapses").alias("n_relapses"), "stats", F.explode(F.arrays_zip("streaks", "progress_points")).alias("z"))
    return rows.select("user_id", "current_label", "n_relapses", F.col("stats.karma").alias("karma"), F.col("z.streaks.id").alias("id"), F.col("z.streaks.days").alias("days"), F.col("z.streaks.label").alias("label"), F.col("z.progress_points.type").alias("type"), F.col("z.progress_points.at_ms").alias("at_ms"))


@query
def streak_seeded(s, d):
    users = V.t(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, "soon").alias("started_at"))
    state, rel = K.seed_streak_state(users, V.relapses(s, d), NOW)
    return K.streak_stats(K.build_streaks(rel, state, NOW))


@query
def record_relapse(s, d):
    rel = V.relapses(s, d)
    cut = NOW - 7 * 86_400_000
    return K.record_relapse(rel.where(F.col("ts_ms") <= cut), rel.where(F.col("ts_ms") > cut), V.streak_users(s, d), NOW)


@query
def chunk_plan(s, d):
    return C.plan_chunks(V.media(s, d))


def _latest(s, d):
    r = V.results(s, d)
    return C.latest_result(r, *(F.desc(c) for c in V.NEWEST[1]))


@query
def latest_result(s, d):
    return _latest(s, d).select("job_id", "chunk_idx", "text", "l_extendedprice")


@query
def pending_chunks(s, d):
    return C.pending_chunks(C.plan_from_totals(V.totals(s, d)), _latest(s, d))


@query
def pending_chunks_strict(s, d):
    return C.pending_chunks(C.plan_from_totals(V.totals(s, d)), _latest(s, d), blank_is_done=False)


@query
def chunk_progress(s, d):
    p = C.chunk_progress(V.totals(s, d), _latest(s, d))
    return p.withColumn("progress", S.progress_pct(F.col("completed"), F.col("total_chunks")))


@query
def final_checkpoint(s, d):
    return C.final_checkpoint(V.totals(s, d), _latest(s, d))


@query
def transcript_rebuild(s, d):
    return C.rebuild_transcripts(V.chunk_texts(s, d))


@query
def manifest_build(s, d):
    m = C.build_manifest(V.manifest_files(s, d), V.media(s, d))
    return m.select("job_id", "kind", "total_chunks", "chunk_seconds", "duration_seconds", F.array_join("chunks", ",").alias("chunks"), "single_file")


@query
def manifest_reuse(s, d):
    probes = V.media(s, d).select("job_id", F.col("duration_seconds").alias("probe_seconds"))
    return C.reusable_manifests(V.manifests(s, d), probes, V.manifest_files(s, d)).select("job_id", "total_chunks", "duration_seconds")


@query
def platform_mix(s, d):
    return V.submissions(s, d).groupBy(S.detect_platform(F.col("url")).alias("platform"), S.platform_label(F.col("url")).alias("label")).agg(F.count("*").alias("n"))


@query
def job_ids(s, d):
    return V.submissions(s, d).select("page_id", S.job_id(F.col("url")).alias("job_id"), S.is_valid_job_id(S.job_id(F.col("url"))).alias("valid"))


@query
def dedupe_submissions(s, d):
    return J.dedupe_submissions(V.submissions(s, d))[0]


@query
def limit_text(s, d):
    return V.t(s, d, "documents").select("doc_id", S.limit_text(F.col("text"), 1000).alias("text"))


@query
def transcript_preview(s, d):
    return V.t(s, d, "documents").select("doc_id", S.transcript_preview(F.concat(F.lit("\t　"), F.col("text"), F.lit("\n "))).alias("preview"))


@query
def safe_filename(s, d):
    c = F.col
    return V.t(s, d, "documents").select("doc_id", S.safe_filename(F.col("text"), F.when(c("doc_id") % 3 == 0, "").when(c("doc_id") % 3 == 1, c("source")), c("lang")).alias("name"))


@query
def export_names(s, d):
    i = F.col("doc_id")
    docs = V.t(s, d, "documents")
    meta = docs.where(i % 5 != 0).select(i.alias("job_id"), F.when(i % 2 == 0, F.col("text")).alias("title"), F.col("source").alias("uploader"), F.when(i % 7 == 0, "https://youtu.be/1").alias("source_url"))
    return W.export_transcripts(docs.select(i.alias("job_id"), F.when(i % 11 != 0, F.col("text")).alias("transcript")), meta).select("job_id", "file_name", F.length("content").cast("long").alias("n_chars"))


@query
def checkpoint_fold(s, d):
    return J.fold_checkpoints(V.patches(s, d), ("view", "click", "purchase", "signup", "error"))


def _status(s, d):
    o, k = V.t(s, d, "orders"), F.col("o_orderkey")
    jobs = o.select(k.alias("job_id"))
    total = (k % 7 + 1).cast("string")
    cp = o.where(k % 4 != 0).select(k.alias("job_id"), F.when(F.col("o_orderstatus") == "O", "transcribing").when(F.col("o_orderstatus") == "F", "complete").alias("status"), F.when(k % 3 != 0, total).alias("totalChunks"), F.when(F.col("o_orderstatus") == "O", (k % 5).cast("string")).alias("currentChunk"), F.when(k % 6 == 0, "").otherwise(F.col("o_orderpriority")).alias("title"), F.when(k % 9 == 0, "HTTP 503").alias("error"))
    meta = o.where(k % 5 != 0).select(k.alias("job_id"), F.concat(F.lit("https://youtu.be/"), k.cast("string")).alias("source_url"), F.lit("stored").alias("title"), F.lit("2024-01-01").alias("updated_at"))
    man = o.where(k % 2 == 0).select(k.alias("job_id"), (k % 7 + 1).cast("int").alias("total_chunks"))
    return J.job_status(jobs, cp, meta, man, _latest(s, d))


@query
def job_status(s, d):
    return _status(s, d)


@query
def job_summary(s, d):
    return J.job_summary(_status(s, d))


@query
def recent_log(s, d):
    return E.recent_log(V.log(s, d))


@query
def event_fold(s, d):
    return E.fold_events(V.log(s, d)).select("job_id", "message", "progress", "step", "done", "error", "last_seq")


@query
def error_classes(s, d):
    docs = V.t(s, d, "documents").join(V.submissions(s, d), F.col("doc_id") == F.col("page_id"), "left")
    text = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("HTTP Error 412 "), F.col("text"))).when(F.col("doc_id") % 10 == 1, F.concat(F.lit("SSLError "), F.col("text"))).otherwise(F.col("text"))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce("url", F.lit("")).alias("url"))
    text = F.col("text")
    rows = rows.withColumn("category", S.download_error_category(text, F.col("url")))
    return rows.select("doc_id", S.is_retryable_error(text).alias("retryable"), S.is_auth_error(text).alias("auth"), "category", F.md5(S.download_error_message(F.col("category"), text)).alias("message_md5"))


@query
def api_errors(s, d):
    i = F.col("event_id")
    body = F.when(i % 4 == 0, F.concat(F.lit('{"code":"'), F.col("event_type"), F.lit('","message":"m'), i.cast("string"), F.lit('","error":"bad"}'))).when(i % 4 == 1, F.concat(F.lit('{"request_id":"r'), i.cast("string"), F.lit('","message":""}'))).when(i % 4 == 2, "not json").otherwise(F.col("props"))
    return V.t(s, d, "events").select("event_id", S.format_api_error(body, F.lit("HTTP 500")).alias("detail"))


@query
def retry_outcome(s, d):
    return A.retry_outcome(V.attempts(s, d))


@query
def first_success(s, d):
    return A.first_success(V.download_attempts(s, d))


@query
def durations(s, d):
    raw = F.when(F.col("event_id") % 5 == 0, "N/A").when(F.col("event_id") % 5 == 1, "").when(F.col("event_id") % 5 == 2, F.concat(F.lit(" "), (F.col("event_id") % 300 - 150).cast("string"), F.lit(" "))).otherwise(F.concat((F.col("event_id") % 900).cast("string"), F.lit(".5")))
    v = S.parse_duration(raw)
    return V.t(s, d, "events").select("event_id", v.alias("seconds"), S.is_valid_media(v).alias("valid"))


@query
def chunk_names(s, d):
    return V.results(s, d).select("job_id", S.chunk_name(F.col("chunk_idx") * 250, "txt").alias("name")).distinct()


@query
def titles(s, d):
    i = F.col("page_id")
    got = S.resolve_title(F.when(i % 3 == 0, "kept").when(i % 3 == 1, ""), F.when(i % 2 == 0, "someone"), F.concat(F.col("url"), F.lit("\n"), F.when(i % 4 != 0, "uploader").otherwise("")))
    return V.submissions(s, d).select("page_id", got["title"].alias("title"), got["uploader"].alias("uploader"))


@query
def chunk_requests(s, d):
    got = S.build_chunk_request(F.encode("text", "utf-8"))
    return V.t(s, d, "documents").select("doc_id", got["encoded_bytes"].alias("encoded_bytes"), got["over_limit"].alias("over_limit"), F.md5(F.get_json_object(got["request"], "$.messages[0].content[0].video_url.url")).alias("url_md5"))


@query
def sse_text(s, d):
    got = P.route_response(F.lit(""), F.col("raw"))
    return V.responses(s, d).select("conv_id", got["text"].alias("text"), got["parse_error"].alias("parse_error"))


@query
def chat_text(s, d):
    got = P.require_text(P.route_response(F.lit("application/json"), F.col("raw")))
    return V.chat_bodies(s, d).select("conv_id", "turn", got["text"].alias("text"), got["error"].alias("error"))


@query
def locate_job(s, d):
    jobs = V.question_transcripts(s, d)
    return J.locate_job(V.questions(s, d).select("question_id", "job_id", "url"), jobs).select("question_id", "found_job_id", "code")


@query
def qa_requests(s, d):
    got = J.qa_requests(V.questions(s, d), V.question_transcripts(s, d), V.question_metadata(s, d))
    return got.select("question_id", "job_id", "code", F.md5(F.get_json_object("prompt", "$.messages[1].content")).alias("prompt_md5"))


def echo(content) -> tuple[str, str]:
    """A deterministic offline model: the content's length and letters as a chat body."""
    import hashlib
    import json

    raw = content if isinstance(content, bytes | bytearray) else content.encode()
    if len(raw) % 10 == 0:
        raise RuntimeError("HTTP 503" if len(raw) % 20 == 0 else "invalid input")
    return json.dumps({"output": {"text": hashlib.md5(bytes(raw)).hexdigest()}}), "application/json"


def no_wait(_: float) -> None:
    pass


@query
def transcribe_batch(s, d):
    docs = V.t(s, d, "documents").select(F.col("doc_id").alias("job_id"), (F.col("doc_id") % 5).cast("int").alias("chunk_idx"), F.encode("text", "utf-8").alias("content"))
    return I.transcribe_chunks(docs, echo, sleep=no_wait).drop("errors")


@query
def answer_batch(s, d):
    got = J.qa_requests(V.questions(s, d), V.question_transcripts(s, d), V.question_metadata(s, d))
    return I.answer_questions(got.withColumn("prompt", F.get_json_object("prompt", "$.messages[1].content")), echo, sleep=no_wait).drop("errors")


def busy(content) -> tuple[str, str]:
    """``echo`` on a bad day: every third length is refused, too."""
    if len(content) % 3 == 0:
        raise RuntimeError("HTTP 429")
    return echo(content)


class Stopped(Exception):
    pass


@query
def transcription_run(s, d):
    """A run that is stopped after its first unit, a second one with the same failing model, and a third with a better one."""
    submissions, media, contents = V.run_inputs(s, d)
    store = U.RunStore(s, shared_path(s, "runs"))
    units = -(-contents.count() // 4)

    def stop(number: int, unit: int) -> None:
        raise Stopped

    try:
        U.transcription_run(submissions, media, contents, busy, store, units, sleep=no_wait, on_unit=stop)
    except Stopped:
        pass
    U.transcription_run(submissions, media, contents, busy, store, units, sleep=no_wait)
    return U.transcription_run(submissions, media, contents, echo, store, units, sleep=no_wait)


def _stream(s, rows: DataFrame, name: str, files: int = 4) -> DataFrame:
    """Rows as a stream of several files in the shared folder."""
    path = shared_path(s, name)
    rows.repartition(files).write.parquet(path)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _updates(s, stream: DataFrame, name: str, key: list[str]) -> DataFrame:
    """Runs a stream in update mode and returns each key's last row."""
    out = shared_path(s, f"{name}-out")

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/b={batch}")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", shared_path(s, f"{name}-cp")).trigger(availableNow=True).start().awaitTermination()
    rows = s.read.parquet(f"{out}/b=*")
    values = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*key, *(F.col(f"v.{c}").alias(c) for c in values))


@query
def stream_job_state(s, d):
    got = _updates(s, L.stream_job_state(_stream(s, V.log(s, d), "events")), "state", ["job_id"])
    return got.select("job_id", "message", "progress", "step", "done", "error", "last_seq")


@query
def stream_checkpoints(s, d):
    return _updates(s, L.stream_checkpoints(_stream(s, V.patches(s, d), "patches")), "checkpoints", ["job_id", "key"])


@query
def upsert_checkpoints(s, d):
    """T2's sink: all patches as a stream, then as another one in other files; the table is that of either."""
    store = Snapshots(s, shared_path(s, "checkpoint-table"), ("job_id", "key"), ("seq",))
    for files in (4, 3):
        L.upsert_checkpoints(_stream(s, V.patches(s, d), "patches", files), store, shared_path(s, "checkpoint-cp")).awaitTermination()
    return store.read()


@query
def stream_streaks(s, d):
    store = Snapshots(s, shared_path(s, "streaks-out"), ("user_id",))
    L.stream_streaks(_stream(s, V.relapses(s, d), "relapses", 3), V.streak_users(s, d), NOW, store, shared_path(s, "streaks-cp")).awaitTermination()
    return store.read()


@query
def stream_progress(s, d):
    rows = V.chunk_texts(s, d).withColumn("ingest_ts", F.timestamp_seconds(F.col("chunk_idx")))
    totals = rows.groupBy("job_id").agg((F.max("chunk_idx") + 1).alias("total_chunks"))
    store = Snapshots(s, shared_path(s, "progress-out"), ("job_id",))
    L.stream_progress(_stream(s, rows, "results", 3), totals, store, shared_path(s, "progress-cp")).awaitTermination()
    return store.read()


@query
def word_progress(s, d):
    p = C.word_progress(V.totals(s, d), C.chunk_words(_latest(s, d)))
    return p.withColumn("progress", S.progress_pct(F.col("completed"), F.col("total_chunks")))


@query
def stream_chunk_words(s, d):
    """T4's second form: counts only, of every result that lineitem ever had."""
    store = Snapshots(s, shared_path(s, "words-out"), ("job_id", "word"))
    L.stream_chunk_words(_stream(s, V.results(s, d).select("job_id", "chunk_idx", "text"), "word-results", 3), store, shared_path(s, "words-cp")).awaitTermination()
    return C.word_progress(V.totals(s, d), store.read())


def _folders(s, rows: DataFrame, name: str, *keys: str) -> str:
    """A text file for each row, in folders key=value by ``keys``."""
    path = shared_path(s, name)
    if len(keys) == 1 and (folder := W.local_folder(path)):
        W.write_text_files(rows.select(*keys, F.lit(0), "value"), folder)
    else:
        rows.repartition(*keys).write.partitionBy(*keys).text(path)
    return path


def _conversations(s, d) -> DataFrame:
    return V.t(s, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("job")).agg(F.count("*").alias("turns"), F.max("turn").alias("last"), F.max("conv_id").alias("n"))


@query
def read_json_objects(s, d):
    """S1: a document per conversation; of every seventh it is corrupt, of every fifth missing."""
    jobs = _conversations(s, d)
    doc = F.when(F.col("n") % 7 == 0, "{bad").otherwise(F.to_json(F.struct("turns", F.concat(F.lit("title "), F.col("job")).alias("title"))))
    path = _folders(s, jobs.where("n % 5 <> 0").select("job", doc.alias("value")), "documents", "job")
    return R.read_json_objects(s, path, "turns long, title string", R.path_key(r"job=([^/]+)/[^/]+$"), jobs.select(F.col("job").alias("job_id")))


@query
def read_texts(s, d):
    """S2: the first turn of each conversation as a file; of every fifth it is missing."""
    first = V.t(s, d, "conversations").where("turn = 0").select(F.col("conv_id").cast("string").alias("job"), "conv_id", F.col("text").alias("value"))
    path = _folders(s, first.where("conv_id % 5 <> 0").drop("conv_id"), "texts", "job")
    return R.read_texts(s, path, R.path_key(r"job=([^/]+)/[^/]+$"), first.select(F.col("job").alias("job_id")))


def _turn_files(s, d) -> str:
    """Each turn as a file whose name has its number: part-<turn>-....txt in the folder of its conversation."""
    rows, path = V.t(s, d, "conversations"), shared_path(s, "turns")
    if folder := W.local_folder(path):
        W.write_text_files(rows.select(F.col("conv_id").alias("job"), F.col("turn").cast("int"), "text"), folder)
        return path
    most = rows.agg(F.max("turn")).first()[0] or 0
    rows.select(F.col("conv_id").alias("job"), "turn", F.col("text").alias("value")).repartitionById(int(most) + 1, F.col("turn").cast("int")).drop("turn").write.partitionBy("job").text(path)
    return path


TURN_FILE, TURN_JOB = r"^part-(\d{3,})-.*\.txt$", r"job=([^/]+)/[^/]+$"


@query
def list_chunk_files(s, d):
    listed = shared_path(s, "listed")  # so that the files are visited once
    R.list_chunk_files(s, _turn_files(s, d), TURN_FILE, R.path_key(TURN_JOB)).write.parquet(listed)
    files = s.read.parquet(listed)
    first = R.first_file(files).select("job_id", F.col("file_name").alias("first"))
    return files.join(first, "job_id").select("job_id", "chunk_idx", "bytes", (F.col("file_name") == F.col("first")).alias("is_first"))


@query
def read_chunk_results(s, d):
    return R.read_chunk_results(s, _turn_files(s, d), R.path_key(TURN_JOB), TURN_FILE).select("job_id", "chunk_idx", "text")


def _event_lines(s, d) -> str:
    """The event log as lines of JSON; every 97th is bad."""
    rows = V.log(s, d).withColumn("job_id", F.col("job_id").cast("string"))
    path = shared_path(s, "log")
    rows.select(F.when(F.col("seq") % 97 == 0, "{bad").otherwise(F.to_json(F.struct(*rows.columns))).alias("value")).write.text(path)
    return path


@query
def read_events(s, d):
    return R.read_events(s, _event_lines(s, d)).select("job_id", "seq", "type", "step", "message", "progress")


@query
def write_events(s, d):
    """S7: the log as a stream, written as lines of JSON and read again."""
    out = shared_path(s, "log-out")
    W.write_events(R.read_events(s, _event_lines(s, d), streaming=True), out, shared_path(s, "log-cp")).awaitTermination()
    return R.read_events(s, out).where("seq is not null").select("job_id", "seq", "type", "step", "message", "progress")


@query
def write_transcripts(s, d):
    """S5: all conversations' transcripts, then those of even jobs anew; the others stay."""
    path = shared_path(s, "transcripts")
    texts = C.rebuild_transcripts(V.chunk_texts(s, d))
    W.write_transcripts(texts, path)
    W.write_transcripts(texts.where("job_id % 2 = 0").withColumn("transcript", F.lit("new")), path)
    return s.read.parquet(path).select("job_id", "transcript")


@query
def upsert_transcripts(s, d):
    """S5 in versions: the same, and every transcript anew in a commit that stops before its version appears."""
    store = Snapshots(s, shared_path(s, "transcript-table"), ("job_id",))
    texts = C.rebuild_transcripts(V.chunk_texts(s, d))
    W.upsert_transcripts(texts, store)
    W.upsert_transcripts(texts.where("job_id % 2 = 0").withColumn("transcript", F.lit("new")), store)
    store._part(texts.withColumn("transcript", F.lit("lost")).withColumn("_commit", F.lit(9).cast("long")))
    return store.read()


@query
def write_json_objects(s, d):
    path = shared_path(s, "objects")
    W.write_json_objects(V.question_metadata(s, d), path, "2024-02-01T00:00:00.000Z")
    return s.read.schema("job_id string, title string, source_url string, updatedAt string").json(path)
