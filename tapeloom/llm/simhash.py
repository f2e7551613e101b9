"""SimHash near-duplicate grouping with bit-sliced distance comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, materialise, words_of

BITS = 64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles (repeats count); 0 for a text without words."""
    words = words_of(text, lower=True)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], seed) for i, j in zip(starts, (ends[shingle - 1 :] - 1).tolist())], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of every row, fp as the signed long with the fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, ceil(n/64)) words: bit j of word w of plane b is bit b of fingerprint 64 w + j."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def close_pairs(fps: np.ndarray, group_end: np.ndarray, radius: int, at_once: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j with j < group_end[i] and at most ``radius`` differing bits.

    Each (i, word of 64 candidates) holds carry-save counters: one word for each binary digit of 64 distances, and a
    word that marks distances over the radius. Every eight planes, words in which all 64 candidates exceed it are left.
    """
    planes, n = bit_planes(fps), len(fps)
    digits = (radius + 1).bit_length()
    first = np.arange(n) // 64
    count = np.where(group_end - 1 > np.arange(n), (group_end - 1) // 64 - first + 1, 0)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    total, begin = np.cumsum(count), 0
    while begin < n:
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + at_once, side="right")))
        rows = np.arange(begin, stop)
        q = np.repeat(rows, count[begin:stop])
        begin = stop
        if not len(q):
            continue
        k = np.arange(len(q)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])
        w = first[q] + k
        ones = ~np.uint64(0)
        low, high = q + 1 - w * 64, group_end[q] - w * 64  # candidates low <= bit < high belong to q
        over = np.where(low > 0, ~(ones << np.minimum(low, 63).astype(np.uint64)), 0) | np.where(high < 64, ones << np.minimum(high, 63).astype(np.uint64), 0)
        over = np.where(low > 63, ones, over)
        counter = [np.zeros(len(q), np.uint64) for _ in range(digits)]
        for bit in range(BITS):
            carry = planes[bit][w] ^ (np.uint64(0) - ((fps[q] >> np.uint64(bit)) & np.uint64(1)))
            for d in range(digits):
                counter[d], carry = counter[d] ^ carry, counter[d] & carry
            over |= carry
            exceeded = ones  # counter == radius + 1, which is sticky in over
            for d in range(digits):
                exceeded = exceeded & (counter[d] if (radius + 1) >> d & 1 else ~counter[d])
            over |= exceeded
            if bit % 8 == 7:
                keep = np.flatnonzero(over != ones)
                if len(keep) < len(q):
                    q, w, over = q[keep], w[keep], over[keep]
                    counter = [c[keep] for c in counter]
                if not len(q):
                    break
        if len(q):
            bits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, j = np.nonzero(bits)
            found.append((q[at], w[at] * 64 + j))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def spanning_stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the pairs link it to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(radius: int):
    def flush(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        end = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
        group_end = np.repeat(end, np.diff(np.append(0, end)))
        i, j = close_pairs(fps, group_end, radius)
        label = spanning_stars(len(fps), i, j)
        at = np.flatnonzero(label != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[at].view(np.int64)), pa.array(fps[label[at]].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by tile; a tile is bounded, so only the last, unfinished one is carried on."""
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for b in batches:
            keys = np.concatenate([keys, b.column(0).to_numpy()])
            fps = np.concatenate([fps, b.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield flush(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield flush(keys, fps)

    return run


def near_links(distinct: DataFrame, radius: int = 2, tile: int = 1024) -> DataFrame:
    """Links (a, b) that span the graph of fingerprints (column fp, distinct) at ``radius`` or fewer differing bits.

    Of radius + 2 blocks of bits, two close fingerprints share two at least: rows meet by each pair of blocks. A bucket
    of over ``tile`` rows is dealt out as bounded tiles, each a pair of hash slices of the bucket, so no link is lost and
    no task holds a hot bucket. A tile returns a spanning forest of its links, never all pairs.
    """
    blocks = radius + 2
    edge = [BITS * k // blocks for k in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", edge[k]).bitwiseAND(F.lit((1 << edge[k + 1] - edge[k]) - 1)) for k in range(blocks)]
    keys = [F.xxhash64(F.lit(n), part[i], part[j]) for n, (i, j) in enumerate(combinations(range(blocks), 2))]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / tile).cast("int").alias("n"))
    met = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("n")).cast("int"))
    low = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))
    dealt = met.select("fp", "key", F.explode(F.when(F.col("n") == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(low)).alias("t"))
    tiles = dealt.select(F.xxhash64("key", "t.x", "t.y").alias("tile"), "fp")
    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3, tile: int = 1024) -> DataFrame:
    """(id, fingerprint, component_id) of every row: documents link at ``radius`` or fewer differing bits.

    component_id is the smallest id that links reach. A null or blank text has fingerprint zero and links like any
    other; repeated rows stay and fall in one component; a null id keeps its row and never becomes a component's id,
    unless no member has one (then null). A text of any length is taken whole, in one task. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    prints, _ = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    first = prints.groupBy("fp").agg(F.min("id").alias("first"))
    links, links_path = materialise(near_links(first.select("fp"), radius, tile), "links")
    paths = [links_path]
    nodes, nodes_path = materialise(connected_components(links, paths).join(first, F.col("node") == F.col("fp")).select("fp", "root", "first"), "nodes")
    lowest = nodes.groupBy("root").agg(F.min("first").alias("lowest"))
    merged, _ = materialise(nodes.join(lowest, "root").select("fp", "lowest"), "components")
    discard(spark, nodes_path, *paths)
    known = first.join(merged, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id"))
    return prints.join(known, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest id; rows with a null id stay.

    Rows that repeat an id stay or go together; texts, empty tables and other columns are as in ``near_duplicates``.
    """
    groups = near_duplicates(docs, id_col, text_col, radius)
    gone = groups.where(F.col(id_col) > F.col("component_id")).select(id_col)
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
