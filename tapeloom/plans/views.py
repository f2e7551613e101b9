"""Views over the test tables with the shape of media jobs, event logs and streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.jscompat import epoch_ms

NOW_MS = 1_706_745_600_000  # 2024-02-01


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streak_users(s, d):
    return t(s, d, "events").groupBy("user_id").agg(epoch_ms(F.min("ts")).alias("started_ms"))


def relapses(s, d):
    return t(s, d, "events").where("event_type = 'error'").select("user_id", epoch_ms(F.col("ts")).alias("ts_ms"))


def submissions(s, d):
    n = (F.col("page_id") % 50).cast("string")
    forms = ["https://www.bilibili.com/video/BV", "https://b23.tv/", "https://youtu.be/", "https://www.YouTube.com/watch?v=", "https://www.tiktok.com/@a/video/", "http://xhslink.com/", "https://x.com/a/status/"]
    url = F.col("url")
    for k, form in enumerate(forms):
        url = F.when(F.col("page_id") % 8 == k, F.concat(F.lit(form), n)).otherwise(url)
    return t(s, d, "pages").select("page_id", url.alias("url"))


def media(s, d):
    return t(s, d, "documents").select(F.col("doc_id").alias("job_id"), F.col("n_chars").cast("double").alias("duration_seconds"))


def totals(s, d):
    return t(s, d, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("total_chunks"))


def results(s, d):
    text = F.when(F.col("l_linestatus") == "F", "x").when(F.col("l_suppkey") % 2 == 0, "").otherwise("  ")
    return t(s, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") - 1).alias("chunk_idx"), text.alias("text"), "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")


NEWEST = [F.desc, ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]


def chunk_texts(s, d):
    text = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "").otherwise(F.col("text"))
    return t(s, d, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").cast("int").alias("chunk_idx"), text.alias("text"))


def _k():
    return F.get_json_object("props", "$.k").try_cast("int")


def patches(s, d):
    value = F.when(_k() % 10 != 0, _k().cast("string"))
    return t(s, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.create_map("event_type", value).alias("patch"))


def log(s, d):
    kind = F.when((F.col("event_type") == "error") & (F.col("event_id") % 10 == 0), "error").when(F.col("event_type") == "purchase", "done").otherwise("status")
    progress = F.when(F.col("event_type").isin("view", "click"), F.col("value"))
    return t(s, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("event_type").alias("step"), F.col("props").alias("message"), progress.alias("progress"))


def _numbered(s, d):
    day = F.floor(epoch_ms(F.col("ts")) / 86_400_000).cast("long")
    e = t(s, d, "events").withColumn("day", day)
    n = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("event_id"))
    return e.withColumn("n", n)


def attempts(s, d):
    error = F.when(F.col("event_type") == "error", "HTTP 503").when(F.col("event_type") == "signup", "invalid input")
    return _numbered(s, d).select(F.col("user_id").alias("job_id"), F.col("day").alias("chunk_idx"), F.col("n").alias("attempt"), error.alias("error"))


def download_attempts(s, d):
    ok = F.col("event_type").isin("view", "click")
    before = F.col("n") - 1
    name = F.element_at(F.array(*map(F.lit, ("default", "ipv4", "legacy_tls", "ipv4_no_certificate_check"))), (before % 4 + 1).cast("int"))
    job = F.concat_ws("-", "user_id", "day", F.floor(before / 4).cast("long"))  # a new job after every fourth event
    return _numbered(s, d).select(job.alias("job_id"), name.alias("strategy"), ok.alias("ok"), F.when(~ok, F.col("event_type")).alias("error"))


def manifests(s, d):
    i, n = F.col("doc_id"), F.col("n_chars")
    duration = (n + i % 4 - 1).cast("double")
    count = F.greatest(F.ceil(n / 120), F.lit(1)).cast("int")
    names = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.format_string("chunk-%03d.mp4", k))
    return t(s, d, "documents").select(i.alias("job_id"), F.when(i % 5 == 0, "audio").otherwise("video").alias("kind"), count.alias("total_chunks"), F.when(i % 7 == 0, 60).otherwise(120).alias("chunk_seconds"), duration.alias("duration_seconds"), names.alias("chunks"), (count == 1).alias("single_file"))


def manifest_files(s, d):
    """The files of the manifests; of every eleventh job the first is missing."""
    rows = manifests(s, d).select("job_id", F.posexplode("chunks").alias("k", "file_name"))
    return rows.where((F.col("job_id") % 11 != 0) | (F.col("k") != 0)).select("job_id", "file_name", F.lit(1.0).alias("duration_seconds"))


def run_inputs(s, d):
    """Conversations as submitted media of a chunk per turn: submissions (url; each twice, and some blank), durations and contents."""
    c = t(s, d, "conversations")
    url = F.concat(F.lit("https://youtu.be/"), F.col("conv_id").cast("string"))
    job = F.substring(F.sha2(url, 256), 1, 16)
    each = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    urls = each.select(F.explode(F.array(url, F.concat(F.lit(" "), url), F.when(F.col("conv_id") % 7 == 0, " "))).alias("url"))
    return urls, each.select(job.alias("job_id"), (F.col("n") * 120.0 - 1).alias("duration_seconds")), c.select(job.alias("job_id"), F.col("turn").cast("int").alias("chunk_idx"), F.encode("text", "utf-8").alias("content"))


def responses(s, d):
    """An event stream per conversation, odd turns as lists of parts."""
    part = F.when(F.col("turn") % 2 == 1, F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct("text")).alias("content")).alias("delta"))).alias("choices")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))))
    c = t(s, d, "conversations").select("conv_id", "turn", F.concat(F.lit("data: "), part).alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda r: r["line"])
    return c.groupBy("conv_id").agg(F.concat(F.array_join(lines, "\n\n"), F.lit("\n\ndata: [DONE]\n")).alias("raw"))


def chat_bodies(s, d):
    own = F.to_json(F.struct(F.struct("text").alias("output")))
    said = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    return t(s, d, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, own).otherwise(said).alias("raw"))


def questions(s, d):
    i = F.col("doc_id")
    job = F.when(i % 17 == 0, "not-an-id").otherwise(F.substring(F.sha2(i.cast("string"), 256), 1, 16))
    return t(s, d, "documents").select(i.alias("question_id"), F.when(i % 13 == 0, " ").otherwise(F.concat(F.lit("Q"), i.cast("string"))).alias("question"), job.alias("job_id"), F.lit("https://youtu.be/1").alias("url"))


def question_transcripts(s, d):
    i = F.col("doc_id")
    return t(s, d, "documents").where(i % 19 != 0).select(F.substring(F.sha2(i.cast("string"), 256), 1, 16).alias("job_id"), F.col("text").alias("transcript"))


def question_metadata(s, d):
    i = F.col("doc_id")
    return t(s, d, "documents").select(F.substring(F.sha2(i.cast("string"), 256), 1, 16).alias("job_id"), F.when(i % 3 != 0, F.col("source")).alias("title"), F.lit("").alias("source_url"))
