"""Files of token ids: records of independent, checksummed blocks in Parquet, one file a task."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import held
from .rangecoder import decode, encode
from .wordtable import WordTable

ROWS = "part int, seq int, n_ids long, doc_sizes array<long>, record binary, doc_sum long"


def _sum(doc_ids: pa.Array, sizes: list[int]) -> int:
    """A checksum of a record's document ids and sizes."""
    return zlib.crc32(repr((doc_ids.to_pylist(), sizes)).encode())


def _table(spec: Broadcast) -> WordTable:
    """This worker's table of words, kept as its encoder is."""
    if (WordTable, spec.value) not in held:
        held[WordTable, spec.value] = WordTable(tokens.encoder(spec))
    return held[WordTable, spec.value]


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, block: int = 2048, segment: int = 6_000_000) -> None:
    """Writes the ids of all texts, each followed by ``end_id``, in ascending id order (null ids first).

    Texts are range-partitioned by id; each task writes one file of records of about ``segment`` ids of whole documents (a
    longer document is a record of its own length). A record stands for itself: a lost task writes its file anew. A null or
    empty text is its end id. Rows of one id are all written, by the hash of their texts and then the texts, so many
    of them are dealt to several tasks and their order does not change. An empty table gives files without records; columns besides id and text are ignored, whatever their names.
    """
    spec = tokens.share(docs.sparkSession, tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, seq = _table(spec), TaskContext.get().partitionId(), 0
        keys, ids, counts, size = [], [], [], 0

        def made() -> pa.RecordBatch:
            doc_ids, sizes = pa.concat_arrays(keys), np.concatenate(counts).tolist()
            row = [part, seq, size, sizes, encode(np.concatenate(ids), block), _sum(doc_ids, sizes)]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(row, types)), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)], ["part", "seq", "n_ids", "doc_sizes", "record", "doc_sum", "doc_ids"])

        for b in batches:
            for at in range(0, b.num_rows, 128):
                some = b.slice(at, 128)
                keys.append(some.column(0))
                got, sizes = table.encode(some.column(1).to_pylist(), end_id)
                ids.append(got)
                counts.append(sizes)
                size += len(got)
                if size >= segment:
                    yield made()
                    keys, ids, counts, size, seq = [], [], [], 0, seq + 1
        if keys:
            yield made()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.xxhash64(text_col).alias("mark"))
    rows = rows.repartitionByRange("id", "mark").sortWithinPartitions("id", "mark", "text")
    rows.mapInArrow(run, f"{ROWS}, doc_ids array<{kind}>").write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, with_ids, the ids as little-endian 32-bit) of every document in files of ``write``.

    start counts the ids of all documents before it: each file's and record's first id comes from the record counts alone.
    Every row that was written comes back, repeated ones too; no order is given. A damaged record raises ValueError. Files
    without records give no rows.
    """
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                doc_ids, sizes = b.column(4)[r].values, b.column(3)[r].as_py()
                if _sum(doc_ids, sizes) != b.column(5)[r].as_py():
                    raise ValueError("checksum of a record's documents differs")
                ids, sizes = decode(b.column(2)[r].as_py()), np.array(sizes, np.int64)
                end = np.cumsum(sizes)
                if (end[-1] if len(end) else 0) != len(ids):
                    raise ValueError("a record's documents do not cover its ids")
                parts = [ids[i:j] for i, j in zip((end - sizes).tolist(), end.tolist())]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0)[r].as_py()] * n, pa.int32()), pa.array([b.column(1)[r].as_py()] * n, pa.int32()), doc_ids, pa.array(end - sizes), pa.array(sizes), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array([p.tobytes() if with_ids else None for p in parts], pa.binary())],
                    ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32", "ids"],
                )

    docs = files.select("part", "seq", "record", "doc_sizes", "doc_ids", "doc_sum").mapInArrow(run, f"part int, seq int, doc_id {kind}, at long, n_tokens long, ids_crc32 long, ids binary")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    records = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("more")).join(parts, "part").select("part", "seq", (F.col("first") + F.col("more")).alias("first"))
    out = docs.join(records, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")
