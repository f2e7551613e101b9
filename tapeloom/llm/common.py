"""Helpers that the operators of this subpackage share: shared folder, connected components, packed arrays."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a task leaves in its worker for the next task of its operator; workers live on, and with them what an operator left that is done.
held: dict[object, object] = {}


def let_go() -> None:
    """Drops what earlier operators left in this worker, for tasks that need the memory themselves."""
    held.clear()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder, which cuts its lineage and survives lost executors; the table and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tapeloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of materialise() that no later plan reads."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def connected_components(edges: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (columns a, b of one orderable type): root is the component's smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Each is an aggregate with map-side
    combination and an equi-join that Spark can split on a hot node; the driver sees only two counts a round.
    The rows are read from a table whose path is added to ``paths``, for a caller that discards it.
    """
    spark = edges.sparkSession
    cur, path = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        large, large_path = materialise(large, "large")
        down = large.where("a > b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt, nxt_path = materialise(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "small")
        discard(spark, path, large_path)
        cur, path = nxt, nxt_path
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    if paths is not None:
        paths.append(path)
    stars = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit hash of two (arrays of) 64-bit values; order matters."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    r"""The words [^\x20\x09-\x0D]+ of a text as UTF-8; lower: with A-Z lower-cased."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()
