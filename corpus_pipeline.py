"""A corpus pipeline: quality filter, near-dedup, substring dedup, packing; each stage is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import nearcopies, packing, quality, substrings
from tapeloom.llm.common import materialise


def free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels table. A null text is judged like an empty one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score, predicted = free(docs, "score"), free(docs, "predicted")
    return quality.classify(docs, labels, score_col=score, predicted_col=predicted).where(F.col(predicted) == 1).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id; rows with a null doc_id stay.

    Documents are near duplicates from a Jaccard similarity of 0.8 of their five-word shingles on. SimHash fingerprints at two or fewer
    differing bits give the first candidates, each confirmed exactly; prefix filtering adds the pairs that fingerprints miss.
    """
    return nearcopies.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that repeat an earlier window of 20 words cut out.

    Texts that lose nothing stay as they are; others have their kept words joined by blanks, and n_chars follows. Rows with a
    null doc_id or text stay unchanged.
    """
    key, mark, new = free(docs, "key"), free(docs, "mark"), free(docs, "new_text")
    found = substrings.remove_repeats(docs).where("n_removed > 0").select(F.col("doc_id").alias(key), F.col("text_hash").alias(mark), F.col("text").alias(new))
    found = found.dropDuplicates([key, mark])  # of repeated rows; each of them gets the same text
    out = docs.join(found, (docs["doc_id"] == found[key]) & (F.xxhash64(docs["text"]) == found[mark]), "left")
    changed = {"text": F.coalesce(F.col(new), F.col("text")).alias("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(key).isNotNull(), F.length(new).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*(changed.get(c, F.col(c)) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in windows of at most 2048, with the ids of each piece; a null text is its end id."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality_filter), ("simhash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("packing", pack)]

#: SQL cannot express hashing into fingerprints, model fitting or tokenizing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
