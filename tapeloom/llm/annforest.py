"""Approximate nearest neighbours with a hash-prefix forest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import best, search, usable


class Forest:
    """For each tree the rows of a block sorted by a long hash string: signs of random projections of the centred vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray, trees: int, bits: int, seed: int):
        self.ids, self.vectors, self.centre, self.bits, self.trees = ids, vectors, centre, bits, trees
        self.scored = 0  # distances taken so far
        self.planes = np.random.default_rng(seed).normal(size=(vectors.shape[1], trees * bits))
        labels = self.labels(vectors)
        self.order = np.argsort(labels, axis=0, kind="stable")
        self.sorted = np.take_along_axis(labels, self.order, axis=0)

    def labels(self, vectors: np.ndarray) -> np.ndarray:
        signs = ((vectors - self.centre) @ self.planes > 0).reshape(len(vectors), self.trees, self.bits)
        return signs.astype(np.float64) @ 2.0 ** np.arange(self.bits - 1, -1, -1)  # whole numbers up to 2**52

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits + 1, trees, queries): first and last place whose hash strings share a prefix of each length with the query's."""
        labels = self.labels(queries)
        shape = (self.bits + 1, self.trees, len(queries))
        low, high = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for t in range(self.trees):
            for level in range(self.bits + 1):
                span = 2.0 ** (self.bits - level)
                start = np.floor(labels[:, t] / span) * span
                low[level, t] = np.searchsorted(self.sorted[:, t], start)
                high[level, t] = np.searchsorted(self.sorted[:, t], start + span)
        return low, high

    def met(self, low: np.ndarray, high: np.ndarray, level: int, seen: np.ndarray) -> np.ndarray:
        """Rows that share a prefix of ``level`` bits with the query in some tree and were not seen; marks them as seen.

        low, high: (bits + 1, trees). Every row of a prefix is taken, so equal vectors come together.
        """
        now = seen.copy()
        for t, (i, j) in enumerate(zip(low[level].tolist(), high[level].tolist())):
            now[self.order[i:j, t]] = True
        rows = np.flatnonzero(now ^ seen)
        seen[rows] = True
        return rows

    def chance(self, query: np.ndarray, rows: np.ndarray, level: int) -> float:
        """How likely rows like these are met at a level, on average: a row at angle a shares each bit with chance 1 - a / pi."""
        x, q = self.vectors[rows] - self.centre, query - self.centre
        size = np.sqrt((x**2).sum(axis=1) * (q @ q))
        cos = np.divide(x @ q, size, out=np.zeros(len(x)), where=size > 0)
        share = 1 - np.arccos(np.clip(cos, -1, 1)) / np.pi
        return float(np.mean(1 - (1 - share**level) ** self.trees))

    def near(self, key: int, query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, recall: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest rows met, all trees ascending together from the longest matched prefix.

        Ascends until ``least`` rows and k neighbours are met and neighbours as far as those found are met with a chance of ``recall``.
        """
        total = (high - low).sum(axis=1)
        level = int(np.flatnonzero(total >= min(max(least, k + 1), len(self.vectors)))[-1])
        seen, rows, far, count = np.zeros(len(self.vectors), bool), np.empty(0, np.int64), np.empty(0), 0
        while True:
            new = self.met(low, high, level, seen)
            count += len(new)
            new = new[self.ids[new] != key]
            rows = np.concatenate([rows, new])
            far = np.concatenate([far, np.sqrt(((self.vectors[new] - query) ** 2).sum(axis=1))])
            keep = best(self.ids[rows], far, k)
            rows, far = rows[keep], far[keep]
            if level == 0 or len(rows) == k and count >= least and self.chance(query, rows, level) >= recall:
                self.scored += count
                return self.ids[rows], far
            level -= 1


def nearest(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, trees: int = 64, bits: int = 48, recall: float = 0.95, share: float = 0.0, sample: int = 5000, block: int = 8192, ask: int = 2048, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k nearest rows found by Euclidean distance, ties to the smaller id.

    Every row is indexed, in blocks with a forest each. A query ascends in each block and takes the exact distances of the
    rows it meets, until rows at the angles of its k nearest so far are met with a chance of ``recall`` (and ``share`` of the
    block's rows are met). So close neighbours end a search early, and vectors without close ones lengthen it. Only the centre of the vectors is fitted, on ``sample`` rows at most (those with
    the least hash of their id, then the least vector). Rows with the query's own id are left out; other repeated rows are
    candidates of their own, and of repeated query ids the least vector asks. Vectors that are null, empty, zero or hold a
    null or non-finite component, and null ids, take no part; only vectors of equal length meet. An empty table gives no
    rows; other columns are ignored, whatever their names. Long vectors
    are rows like others: a task holds a block of them and their hash strings.
    """
    if not 0 < bits <= 52:
        raise ValueError("hash strings have 1 to 52 bits")
    v = F.col(vector_col)
    part = table.where(F.col(id_col).isNotNull() & usable(v) & F.exists(v, lambda x: x != 0))
    rows = part.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), is_query.alias("asks"))
    fitted: dict[int, list[np.ndarray]] = {}
    for r in rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id", "v").limit(sample).collect():
        fitted.setdefault(len(r.v), []).append(np.array(r.v))
    centres = {d: np.mean(x, axis=0) for d, x in fitted.items()}

    def index(ids: np.ndarray, x: np.ndarray) -> Forest:
        return Forest(ids, x, centres.get(x.shape[1], np.zeros(x.shape[1])), trees, bits, seed)

    def answer(forest: Forest, keys: np.ndarray, asked: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, ids = [], forest.ids
        least = int(share * len(ids))
        for at in range(0, len(keys), 256):
            low, high = forest.ranges(asked[at : at + 256])
            out += [forest.near(key, asked[at + i], low[:, :, i], high[:, :, i], k, recall, least) for i, key in enumerate(keys[at : at + 256].tolist())]
        return out

    return search(rows, F.col("asks"), index, answer, "double", k, [F.col("score")], block, ask)
