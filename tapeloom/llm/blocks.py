"""A stated query set against all rows, in bounded blocks that Spark deals out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tiles beyond this number share tasks, which hold one tile at a time.
MOST_TASKS = 20_000


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


Found = tuple[np.ndarray, np.ndarray]


def search(rows: DataFrame, is_query: Column, index: Callable[[np.ndarray, np.ndarray], Any], answer: Callable[[Any, np.ndarray, np.ndarray], list[Found]], score: str, k: int, order: list[Column], block: int, ask: int = 2048) -> DataFrame:
    """The k best (query_id, rank, vec_id, score) of each query by ``order`` and then vec_id.

    rows: (id long, v array) without nulls. The work is dealt as tiles of about ``block`` rows and ``ask`` queries, both by a hash
    of id and vector, so that many rows of one id are many tiles' work and a lost executor repeats tiles only. A row goes to each
    slice of queries and a query to each block. A task makes the index of a tile's rows from (ids, vectors) and answers
    queries as they stream by, so its memory holds a block and a batch whatever the table's size. ``answer`` gives the
    block's k best (vec_ids, scores) for each of some queries. Only vectors of equal length meet. Of repeated query ids
    the least vector asks.
    """
    n, n_asked = rows.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, slices = max(1, -(-n // block)), max(1, -(-n_asked // ask))

    def dealt(count: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    base = rows.select("id", "v", F.size("v").alias("len"))
    candidates = base.select(dealt(blocks, 0).alias("block"), every(slices).alias("slice"), "len", F.lit(False).alias("asks"), "id", "v")
    asked = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")).withColumn("len", F.size("v"))
    asked = asked.select(every(blocks).alias("block"), dealt(slices, 1).alias("slice"), "len", F.lit(True).alias("asks"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, made = None, [], [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "slice", "len", "asks")], axis=1)
            edge = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for i, j in zip(edge, edge[1:]):
                if i == j:
                    continue
                if now != (here := tuple(keys[i, :3].tolist())):
                    now, ids, vectors, made = here, [], [], None
                part_ids = b.column("id").slice(i, j - i).to_numpy()
                part = b.column("v").slice(i, j - i).flatten().to_numpy().reshape(j - i, now[2])
                if not keys[i, 3]:
                    ids.append(part_ids)
                    vectors.append(part)
                elif ids:
                    made = index(np.concatenate(ids), np.concatenate(vectors)) if made is None else made
                    found = answer(made, part_ids, part)
                    sizes = [len(f[0]) for f in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part_ids, sizes)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "vec_id", "score"])

    both = candidates.union(asked).repartition(min(blocks * slices, MOST_TASKS), "block", "slice").sortWithinPartitions("block", "slice", "len", "asks", "id", "v")
    found = both.mapInArrow(run, f"query_id long, vec_id long, score {score}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        near = np.flatnonzero(scores <= np.partition(scores, k - 1)[k - 1])
        return near[np.lexsort((ids[near], scores[near]))[:k]]
    return np.lexsort((ids, scores))[:k]
