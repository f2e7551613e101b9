"""Tables in buckets of a key, of which whole keys are replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def replace_keys(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Replaces the rows of the keys in ``rows`` in a table of key buckets; only touched buckets are written, at once.

    A table keeps the number of buckets it began with. More buckets mean less to rewrite for a few keys and more files.
    """
    spark = rows.sparkSession
    new = rows.withColumn(BUCKET, bucket_of(key, buckets))
    if path_exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path)
        touched = new.select(BUCKET).distinct()
        stay = old.join(F.broadcast(touched), BUCKET, "left_semi").join(new.select(key), key, "left_anti").select(*new.columns)  # at most ``buckets`` rows
        new = new.unionByName(stay)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
