"""Sources: JSON documents, whole texts, file listings and event logs. Missing or corrupt files read as empty, by joins."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schemas import EVENTS

#: File names of chunks and of their results (three digits or more), source media by extension.
CHUNK_FILE = r"(?i)^chunk-(\d{3,})\.(mp3|mp4)$"
RESULT_FILE = r"(?i)^chunk-(\d{3,})\.txt$"
PATH = "_metadata.file_path"
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listed_by_few(spark: SparkSession) -> Iterator[None]:
    """Folders that are loaded within are listed by some eight tasks a core, instead of a task for each folder (up to 10,000)."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), max(32, 8 * spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def read_by_few(files: DataFrame) -> DataFrame:
    """The same rows from at most 32 tasks a core: small files are dealt to tasks as if each had 4 MB, and tasks read file after file."""
    return files.coalesce(32 * files.sparkSession.sparkContext.defaultParallelism)


def path_key(pattern: str = r"([^/]+)/[^/]+$") -> Column:
    """A key from a file's path; by default the folder that holds it."""
    return F.regexp_extract(F.col(PATH), pattern, 1)


def read_json_objects(spark: SparkSession, path: str, schema: str, key: Column | None = None, expected: DataFrame | None = None) -> DataFrame:
    """(job_id, fields of ``schema``): a JSON document per file of a folder and those below it; a corrupt one has nulls, as has a missing one of ``expected`` (job_id)."""
    with listed_by_few(spark):
        rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = rows.select((path_key() if key is None else key).alias("job_id"), *rows.columns)
    return rows if expected is None else expected.select("job_id").join(rows, "job_id", "left")


def read_texts(spark: SparkSession, path: str, key: Column | None = None, expected: DataFrame | None = None) -> DataFrame:
    """(job_id, text): a whole text per file of a folder and those below it; an empty or missing one of ``expected`` (job_id) is ''."""
    rows = list_files_text(spark, path).select((path_key() if key is None else key).alias("job_id"), F.col("value").alias("text"))
    return rows if expected is None else expected.select("job_id").join(rows, "job_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def list_chunk_files(spark: SparkSession, path: str, pattern: str = CHUNK_FILE, key: Column | None = None, with_content: bool = False) -> DataFrame:
    """(job_id, file_name, chunk_idx, bytes, content if asked for) of files whose name fits; the content is not read otherwise."""
    with listed_by_few(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.col("_metadata.file_name")
    out = files.where(name.rlike(pattern)).select((path_key() if key is None else key).alias("job_id"), name.alias("file_name"), F.regexp_extract(name, pattern, 1).try_cast("int").alias("chunk_idx"), F.col("length").alias("bytes"), *(["content"] if with_content else []))
    return read_by_few(out)


def first_file(files: DataFrame) -> DataFrame:
    """(job_id, file_name): each job's first file by name."""
    return files.groupBy("job_id").agg(F.min("file_name").alias("file_name"))


def read_chunk_results(spark: SparkSession, path: str, key: Column | None = None, pattern: str = RESULT_FILE) -> DataFrame:
    """(job_id, chunk_idx, text, ingest_ts) of result files, whose names hold the chunk's number; the time is the file's.

    Files are read as bytes, which takes a sixth of the text reader's time for small ones; so compressed ones stay as they are.
    """
    with listed_by_few(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.col("_metadata.file_name")
    return read_by_few(files.where(name.rlike(pattern)).select((path_key() if key is None else key).alias("job_id"), F.regexp_extract(name, pattern, 1).try_cast("int").alias("chunk_idx"), F.col("content").cast("string").alias("text"), F.col("_metadata.file_modification_time").alias("ingest_ts")))


def list_files_text(spark: SparkSession, path: str) -> DataFrame:
    with listed_by_few(spark):
        return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)


def read_events(spark: SparkSession, path: str, streaming: bool = False, schema: str = EVENTS, mode: str = "PERMISSIVE", max_files: int | None = None) -> DataFrame:
    """Events of newline-framed JSON: blank lines go, an unended last line counts; a bad line has nulls, or stops with FAILFAST."""
    reader = (spark.readStream if streaming else spark.read).schema(schema).option("mode", mode)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)
