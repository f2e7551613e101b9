"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import best, search, usable


class Lists:
    """A block's vectors and, for each dimension, its rows sorted by value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.up = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, self.up, axis=0)
        self.largest, self.scored = np.abs(vectors.astype(float)).max(axis=0, initial=0), 0

    def top(self, query_id: int, q: np.ndarray, k: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k largest inner products with q, ties to the smaller id.

        Reads the lists in parallel from the end that favours q, scores each row when it is first seen, and stops when the
        sum of what the lists can still offer is under the kth score (at equality a smaller id could still come).
        """
        n, dims = len(self.ids), np.flatnonzero(q)
        vectors, values = self.vectors, self.values
        if float(np.abs(q.astype(float)) @ self.largest) >= 2.0**62:  # sums may pass a long, so whole numbers of any size
            q, vectors, values = q.astype(object), vectors.astype(object), values.astype(object)
        fall = q[dims] > 0
        weight, seen = q[dims], np.zeros(n, bool)
        ids, scores = np.empty(0, np.int64), np.empty(0, q.dtype)
        depth = 0
        while depth < n:
            read = np.arange(depth, min(n, depth + step))
            depth, step = read[-1] + 1, step * 2
            place = np.where(fall, n - 1 - read[:, None], read[:, None])
            now = seen.copy()
            now[self.up[place, dims] if len(dims) else slice(None)] = True
            rows = np.flatnonzero(now ^ seen)
            seen = now
            rows = rows[self.ids[rows] != query_id]
            self.scored += len(rows)
            ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, vectors[rows] @ q])
            keep = best(ids, -scores, k)
            ids, scores = ids[keep], scores[keep]
            bound = int(weight @ values[place[-1], dims]) if len(dims) else 0
            if len(ids) == k and bound < scores[-1] or seen.all():
                break
        if len(scores) and max(abs(int(x)) for x in scores) >= 2**63:
            raise ValueError("a score does not fit a long")
        return ids, scores.astype(np.int64)


def top_inner_products(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, k: int = 5, block: int = 8192, ask: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k largest inner products of floor(scale * x) among all other rows.

    Exact; fewer than k candidates give fewer rows. Rows with the query's own id are left out; other repeated rows are
    candidates of their own, and of repeated query ids the least vector asks. Vectors that are null, empty or hold a null or
    non-finite component, and null ids, take no part; only vectors of equal length meet. A score among a block's k
    that does not fit a long stops the job. Long vectors are rows like others: a task holds a block of them and its lists. An empty table gives no rows; other columns are ignored, whatever their names.

    Each block has its own sorted lists. How soon the bound stops depends on the vectors: where few components dominate it
    stops early, for vectors of many alike components (random ones) nearly all rows are scored before it does.
    """
    v = F.col(vector_col)
    part = table.where(F.col(id_col).isNotNull() & usable(v))
    rows = part.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"), is_query.alias("asks"))

    def answer(lists: Lists, ids: np.ndarray, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [lists.top(key, q, k) for key, q in zip(ids.tolist(), queries)]

    return search(rows, F.col("asks"), Lists, answer, "long", k, [F.desc("score")], block, ask)
