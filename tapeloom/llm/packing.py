"""Packing of token ids into training windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

#: Ids of a piece that are cut in powers of two: 64, 32, ... 1.
FINE = 127
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def difference(sizes: np.ndarray, ways: int) -> np.ndarray:
    """The way of each item after Karmarkar-Karp differencing into ``ways`` sums.

    A partial partition starts as one item in one way. The two with the widest spread merge with opposing imbalances, the
    largest sums of one on the smallest of the other, until one is left. Ways that hold items on both sides join as a
    node over the two, so that members are read once, from the last partition down.
    """
    n = len(sizes)
    if ways == 1 or n == 0:
        return np.zeros(n, np.int64)
    below: list[tuple[int, int]] = []  # the two nodes that node n + k joins
    # spread, tie, ways in use as (sum, node) from the smallest
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        alone = ways - len(a)
        if len(b) <= alone:
            if len(b) == 1:
                insort(a, b[0])
            else:
                a = sorted(a + b)
        else:
            # the largest of b take the empty ways; of the rest the largest meets the smallest of a
            rest = b[: len(b) - alone]
            free = b[len(b) - alone :]
            k = len(rest)
            joined = []
            for (x, i), (y, j) in zip(a[:k], reversed(rest)):
                joined.append((x + y, n + len(below)))
                below.append((i, j))
            if k == 1 and not free:
                a = a[1:]
                insort(a, joined[0])
            else:
                a = sorted(a[k:] + joined + free)
        heapq.heappush(heap, ((a[0][0] if len(a) == ways else 0) - a[-1][0], tie, a))
        tie += 1
    way = np.full(n + len(below), -1)
    for w, (_, node) in enumerate(reversed(heap[0][2])):
        way[node] = w
    for k in range(len(below) - 1, -1, -1):
        i, j = below[k]
        way[i] = way[j] = way[n + k]
    return way[:n]


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each item and their number, which rises until no window is over capacity."""
    ways = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        way = difference(sizes, ways)
        if not len(sizes) or np.bincount(way, sizes).max() <= capacity:
            return way, ways
        ways += 1


def powers(n: int) -> list[int]:
    """n as a sum of falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Packs the documents of one task; each id lies in exactly one piece.

    Full windows of a long document are sequences of their own. What is left of each document is gathered up to
    ``group`` windows, cut in pieces of ``piece`` ids at most and differenced into near-equal windows; a few pieces are cut
    again in powers of two, which lets differencing even out the last ids. Beforehand the group's last ids, less than one
    window, are cut off in powers of two, which need no padding, so that the windows are as full as ``slack`` allows.
    """

    def __init__(self, capacity: int, group: int, piece: int, slack: int):
        self.capacity, self.room, self.piece, self.slack = capacity, capacity * group, piece, slack
        self.held: list[tuple[int, int]] = []  # document, first id
        self.size = 0
        self.docs: list[np.ndarray] = []
        self.sequence = TaskContext.get().partitionId() << 40 if TaskContext.get() else 0
        self.out: list[tuple[int, int, int, int, int]] = []  # document, start, length, sequence, offset

    def add(self, ids: np.ndarray) -> None:
        doc = len(self.docs)
        self.docs.append(ids)
        full = len(ids) // self.capacity
        for k in range(full):
            self.out.append((doc, k * self.capacity, self.capacity, self.sequence, 0))
            self.sequence += 1
        if full * self.capacity < len(ids):
            self.held.append((doc, full * self.capacity))
            self.size += len(ids) - full * self.capacity

    def full(self) -> bool:
        return self.size >= self.room

    def pack(self) -> None:
        """Packs all that is held."""
        target = self.capacity - self.slack
        rest = self.size % target
        pieces = []
        for doc, start in self.held:
            end = len(self.docs[doc])
            while start < end:
                size = min(self.piece, end - start)
                if end - start - size < self.piece // 8:
                    size = min(end - start, self.piece + self.piece // 8)
                pieces.append((doc, start, size))
                start += size
        while rest:  # the last pieces, cut where the rest ends
            doc, start, size = pieces.pop()
            take = min(size, rest)
            if size > take:
                pieces.append((doc, start, size - take))
            at = start + size - take
            for part in powers(take):
                self.out.append((doc, at, part, self.sequence, 0))
                self.sequence += 1
                at += part
            rest -= take
        fine = powers(FINE)
        for k in [k for k, p in enumerate(pieces) if p[2] > FINE][: self.room // self.capacity // 2]:
            doc, start, size = pieces[k]
            pieces[k] = (doc, start, size - FINE)
            at = start + size - FINE
            for part in fine:
                pieces.append((doc, at, part))
                at += part
        way, ways = windows(np.array([p[2] for p in pieces], np.int64), self.capacity)
        used = [0] * ways
        for (doc, start, size), w in zip(pieces, way.tolist()):
            self.out.append((doc, start, size, self.sequence + w, used[w]))
            used[w] += size
        self.sequence += ways
        self.held, self.size = [], 0


def _run(spec, end_id: int, capacity: int, group: int, piece: int, slack: int, with_ids: bool):
    def rows(packer: Packer, keys: list) -> pa.RecordBatch:
        ids = [packer.docs[d][s : s + n] for d, s, n, _, _ in packer.out]
        cols = list(zip(*packer.out)) or [()] * 5
        doc = [pa.array(c, pa.int64()) for c in cols]
        batch = pa.RecordBatch.from_arrays(
            [pa.concat_arrays(keys).take(doc[0]) if keys else pa.nulls(0), doc[1], doc[2], pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([len(packer.docs[d]) for d in cols[0]], pa.int64()), doc[3], doc[4], pa.array([x.tobytes() if with_ids else None for x in ids], pa.binary())],
            ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
        )
        packer.out = []
        return batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(spec)
        packer, keys = Packer(capacity, group, piece, slack), []
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                keys.append(part.column(0))
                for got in encode.encode(part.column(1).to_pylist()):
                    packer.add(np.append(np.frombuffer(got, "<u4"), np.uint32(end_id)))
                if packer.full():
                    packer.pack()
                    yield rows(packer, keys)
                    packer.docs, keys = [], []
        if keys:
            packer.pack()
            yield rows(packer, keys)

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = 2048, group: int = 64, piece: int = 512, slack: int = 4, with_ids: bool = True, task_bytes: int = 4 << 20) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and (with_ids) the ids as little-endian 32-bit.

    ``tokenizer`` is the path of a tokenizers JSON file. One narrow stage: each task packs its own documents, in groups of
    ``group`` windows, so memory and work do not depend on the table's size and nothing is shuffled. Partitions are
    coalesced until there is at most one for each ``task_bytes`` of text, since a task's last ids, less than one window, are
    sequences of powers of two: so these hold under 1 % of a large table's ids however it is partitioned. A full
    window of a long document is a sequence by itself, with nothing left to even out. Sequence numbers
    start with the task's number; a repeated task with the same input gives the same rows. A null or empty text is one
    piece with the end id; repeated rows and null ids are packed as rows of their own; a text of any length is packed whole.
    An empty table gives no rows; other columns are ignored, whatever their names.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kind = docs.schema[id_col].dataType.simpleString()
    spec = tokens.share(docs.sparkSession, tokenizer)
    out = texts.coalesce(max(1, size // task_bytes)).mapInArrow(_run(spec, end_id, capacity, group, piece, slack, with_ids), f"id {kind}, {SCHEMA}")
    out = out.withColumnRenamed("id", id_col)
    return out if with_ids else out.drop("ids")
