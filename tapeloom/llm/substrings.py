"""Exact substring dedup by level-wise doubling of repeated word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, let_go, materialise, mix, words_of

CHUNKS = "chunk long, ids binary, marks binary, sizes binary, words binary, codes binary, n_words long"


def _zip(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x if isinstance(x, bytes) else x.tobytes())


def _unzip(x: bytes, kind: str | None = None):
    raw = zstandard.ZstdDecompressor().decompress(x)
    return np.frombuffer(raw, kind) if kind else raw


def _chunks(batches: Iterator[pa.RecordBatch], at_least: int) -> Iterator[pa.RecordBatch]:
    """Documents as chunks of about ``at_least`` words: the chunk's distinct words and a code for each word."""
    number = TaskContext.get().partitionId() << 32
    ids, marks, sizes, parts, code = [], [], [], [], {}
    total = 0
    let_go()

    def made() -> pa.RecordBatch:
        codes = np.concatenate(parts).astype("<i4") if parts else np.empty(0, "<i4")
        row = [number, _zip(np.array(ids, "<i8")), _zip(np.array(marks, "<i8")), _zip(np.array(sizes, "<i8")), _zip(b" ".join(code)), _zip(codes), len(codes)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), *[pa.binary()] * 5, pa.int64()))], ["chunk", "ids", "marks", "sizes", "words", "codes", "n_words"])

    for b in batches:
        for key, text, mark in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            words = words_of(text.as_py())
            for w in words:
                if w not in code:
                    code[w] = len(code)
            parts.append(np.fromiter(map(code.__getitem__, words), np.int32, len(words)))
            ids.append(key)
            marks.append(mark)
            sizes.append(len(words))
            total += len(words)
            if total >= at_least:
                yield made()
                number += 1
                ids, marks, sizes, parts, code, total = [], [], [], [], {}, 0
    if ids:
        yield made()


class Chunk:
    """A chunk's words as hashes of 64 bits and of 64 more, and the windows of its documents."""

    def __init__(self, ids: bytes, sizes: bytes, words: bytes, codes: bytes):
        let_go()
        self.ids, self.sizes, self.codes = _unzip(ids, "<i8"), _unzip(sizes, "<i8"), _unzip(codes, "<i4")
        self.words = _unzip(words).split(b" ") if len(self.codes) else []
        both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in self.words]), "<u8").reshape(-1, 2)
        self.end = np.cumsum(self.sizes)
        self.number = np.int32 if max(len(self.codes), len(self.ids)) < 2**31 - 1 else np.int64  # holds a position, at half the memory if it can
        self.doc = np.repeat(np.arange(len(self.ids), dtype=self.number), self.sizes)
        self.both, self.known = both, {}

    def id_of(self, at: np.ndarray) -> np.ndarray:
        """The ids of the documents of these positions."""
        return self.ids.take(self.doc.take(at))

    def place_of(self, at: np.ndarray) -> np.ndarray:
        """These positions, counted from where their documents begin."""
        return at - (self.end - self.sizes).take(self.doc.take(at))

    def _hash(self, k: int, n: int) -> np.ndarray:
        """The k-th hash of the n words from each position on, by doubling; only what n is made of is held."""
        power, size, out, length = self.both[:, k][self.codes], 1, None, 0
        while True:
            if n & size:
                length += size
                m = max(0, len(self.codes) - length + 1)
                out = power if out is None else mix(power[:m], out[size : size + m] + np.uint64(length))
            if 2 * size > n:
                return out
            m = max(0, len(self.codes) - 2 * size + 1)
            power = mix(power[:m], power[size : size + m] + np.uint64(2 * size))
            size *= 2

    def hashes(self, n: int) -> np.ndarray:
        """The hash of the n words from each position on (those that leave their document have no meaning)."""
        if n not in self.known:
            self.known[n] = self._hash(0, n)
        return self.known[n]

    def checks(self, n: int) -> np.ndarray:
        """32 bits of another hash of the n words from each position on."""
        return (self._hash(1, n) >> np.uint64(32)).astype(np.uint32)

    def inside(self, n: int) -> np.ndarray:
        """Whether the n words from each position on are of one document."""
        m = max(0, len(self.codes) - n + 1)
        return self.doc[:m] == self.doc[n - 1 : n - 1 + m] if m else np.empty(0, bool)

    def may_repeat(self, found: dict[int, np.ndarray], first: int) -> tuple[int, np.ndarray]:
        """The length that the levels in ``found`` lead to, and where windows of it start that may repeat elsewhere.

        found: of each level's length, from ``first`` on, the hashes at anchors that other chunks have too.
        """
        n, may = first, self.inside(first)
        while n in found:
            at = self.anchors(n, may)
            keep = at[np.isin(self.hashes(n)[at], found[n])]
            near = np.zeros(len(self.codes) + 1, self.number)  # starts of 2n-word windows that hold such an anchor
            np.add.at(near, np.maximum(keep - n, 0), 1)
            np.add.at(near, keep + 1, -1)
            whole = self.doubled(n, may)
            may = whole & (np.cumsum(near, out=near)[: len(whole)] > 0)
            n *= 2
        return n, may

    def doubled(self, n: int, may: np.ndarray) -> np.ndarray:
        """Where 2n-word windows start whose n-word windows all may repeat."""
        whole = self.inside(2 * n)
        total = np.zeros(len(may) + 1, self.number)
        np.cumsum(may, out=total[1:])
        return whole & (total[n + 1 : n + 1 + len(whole)] - total[: len(whole)] == n + 1)

    def anchors(self, n: int, may: np.ndarray) -> np.ndarray:
        """Positions of n-word windows with the least hash among those of a 2n-word window that may repeat.

        Two equal windows of 2n words have the same anchor at the same place, so both survive if all repeated n-word
        windows at anchors do.
        """
        span = n + 1  # n-word windows in one of 2n words
        whole = self.doubled(n, may)
        m = len(whole)
        if not m:
            return np.empty(0, np.int64)
        h = self.hashes(n)
        best = np.zeros(m + 2 * (span - 1), np.uint64)
        best[span - 1 : span - 1 + m] = np.where(whole, _slide(h, span, np.minimum)[:m], 0)
        best = _slide(best, span, np.maximum)[: len(h)] == h
        total = np.zeros(len(h) + 1, self.number)
        np.cumsum(whole, out=total[1 : m + 1])
        total[m + 1 :] = total[m]
        some = total[1:] > 0
        some[span - 1 :] = total[span:] > total[:m]
        return np.flatnonzero(some & best)


def _slide(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """best over x[i : i + n] for each i."""
    size = 1
    while size * 2 <= n:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def _bucketed(chunk: int, hashes: np.ndarray, buckets: int, *more: np.ndarray) -> Iterator[tuple]:
    """Rows (bucket, chunk, hashes, more ...) of a chunk's sorted hashes, dealt by their leading bits."""
    cut = np.searchsorted(hashes, (np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - (buckets.bit_length() - 1))))
    cut = [0, *cut.tolist(), len(hashes)]
    for b, (i, j) in enumerate(zip(cut, cut[1:])):
        if i < j:
            yield (b, chunk, hashes[i:j].tobytes(), *(m[i:j].tobytes() for m in more))


def _rows(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names)


def _find(keys: np.ndarray, checks: np.ndarray, key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """The place of each (key, check), all of which are there, among distinct ones sorted by key and check."""
    at = np.searchsorted(keys, key)
    off = np.flatnonzero(checks[at] != check)
    while len(off):  # keys that differ in the check only
        at[off] += 1
        off = off[checks[at[off]] != check[off]]
    return at


RESULT = ["text_hash", "n_words", "n_removed", "kept_sha256", "text"]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, chunk_words: int = 1 << 20, bucket_hashes: int = 1 << 17, first: int | None = None) -> DataFrame:
    """One row per document: id, text_hash (xxhash64 of the input text), n_words, n_removed, kept_sha256 and text, the kept
    words joined by blanks.

    A window of ``min_words`` words is removed if its words also start earlier (smaller id, or earlier in the same
    document); windows are judged on the input. Level by level, windows of ``first`` words (half of ``min_words``, unless
    given) are compared between chunks at anchors that any two equal windows of twice the length share; only those that
    repeat are extended to twice their length and compared again, until none survives or the length is ``min_words``.
    There the doubling ends, as longer repeats consist of such windows.

    Words are dealt in chunks, written once to the shared folder; a chunk sends each distinct hash once, so a passage in
    a third of all documents costs a row per chunk. Levels compare 64-bit hashes, which only chooses candidates; windows
    are removed by 96 bits. A null or empty text has no words; texts of any length are taken whole; a null id keeps its row
    and its words and is not compared; of rows with the same id none is earlier than another at the same place. Repeated
    rows give a row each. Other columns are ignored, whatever their names. An empty table gives no rows. Ids of another type
    than whole numbers are compared in the order that Spark sorts them in.
    """
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        ids = docs.select(F.col(id_col).alias("name")).where("name is not null").distinct().repartitionByRange("name").sortWithinPartitions("name")
        ids, _ = materialise(ids.select("name", F.monotonically_increasing_id().alias("id")), "ids")  # ascending, with gaps
        texts = docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("text")).join(ids, "name", "left").drop("name")
        return remove_repeats(texts, "id", "text", min_words, chunk_words, bucket_hashes, first).join(ids, "id", "left").select(F.col("name").alias(id_col), *RESULT)
    first = first or min_words // 2
    if min_words % first or (min_words // first).bit_count() != 1 or min_words == first:
        raise ValueError("min_words is the first level's length, doubled some times")
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    chunks, chunks_path = materialise(source.where("id is not null").mapInArrow(lambda it: _chunks(it, chunk_words), CHUNKS), "chunks", "uncompressed")
    n_words = chunks.agg(F.sum("n_words")).first()[0] or 0
    buckets = 1 << max(3, (n_words // 6 // bucket_hashes).bit_length())

    def levels(right: pd.DataFrame) -> dict[int, np.ndarray]:
        return {n: gathered(right[right["level"] == n]) for n in set(right["level"])}

    def candidates(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in left.to_dict("records"):
            c = Chunk(r["ids"], r["sizes"], r["words"], r["codes"])
            n, may = c.may_repeat(levels(right), first)
            rows += _bucketed(r["chunk"], np.unique(c.hashes(n)[c.anchors(n, may)]), buckets)
        return _rows(rows, ["bucket", "chunk", "hashes"])

    def all_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pd.DataFrame({"level": [], "hashes": []})
        for b in batches:
            for r in b.to_pylist():
                rows = candidates(pd.DataFrame([r]), none)
                yield pa.RecordBatch.from_pandas(rows, pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary())]), preserve_index=False)

    def in_several(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(h, "<u8") for h in pdf["hashes"]]
        every, count = np.unique(np.concatenate(parts), return_counts=True)
        every = every[count > 1]
        rows = []
        for chunk, h in zip(pdf["chunk"], parts):
            if len(got := h[np.isin(h, every, assume_unique=True)]):
                rows.append((chunk, got.tobytes()))
        return _rows(rows, ["chunk", "hashes"])

    def gathered(pdf: pd.DataFrame, column: str = "hashes", kind: str = "<u8") -> np.ndarray:
        return np.concatenate([np.frombuffer(h, kind) for h in pdf[column]]) if len(pdf) else np.empty(0, kind)

    def firsts(c: Chunk, at: np.ndarray, checks: np.ndarray):
        """Distinct windows at these starts, by hash and check, the start of the earliest of each, all starts sorted by windows, and the window's number of each."""
        if (c.ids[1:] <= c.ids[:-1]).any():
            at = at[np.lexsort((c.place_of(at), c.id_of(at)))]
        at = at[np.lexsort((checks.take(at), c.hashes(min_words).take(at)))]  # stable, so the earliest comes first
        h, check = c.hashes(min_words).take(at), checks.take(at)
        lead = np.append(True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])) if len(h) else np.empty(0, bool)
        return h[lead], check[lead], at[lead], at, np.cumsum(lead, dtype=c.number) - c.number(1)

    def wholes(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in left.to_dict("records"):
            c = Chunk(r["ids"], r["sizes"], r["words"], r["codes"])
            n, may = c.may_repeat(levels(right), first)
            if n == min_words:
                h, check, start, _, _ = firsts(c, np.flatnonzero(may), c.checks(min_words))
                rows += _bucketed(r["chunk"], h, buckets, check, c.id_of(start), c.place_of(start).astype("<i4" if c.sizes.max(initial=0) <= 2**31 else "<i8"))
        return _rows(rows, ["bucket", "chunk", "hashes", "checks", "ids", "places"])

    def not_first(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(h, "<u8") for h in pdf["hashes"]]
        h = np.concatenate(parts)
        check, ids = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["checks"]]), np.concatenate([np.frombuffer(x, "<i8") for x in pdf["ids"]])
        places = np.concatenate([np.frombuffer(x, f"<i{len(x) // len(p)}").astype(np.int64) for x, p in zip(pdf["places"], parts)])
        chunk = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.lexsort((places, ids, check, h))
        h, check, ids, places, chunk = h[order], check[order], ids[order], places[order], chunk[order]
        lead = np.append(True, (h[1:] != h[:-1]) | (check[1:] != check[:-1]))
        start = np.maximum.accumulate(np.where(lead, np.arange(len(h)), 0))
        late = (ids != ids[start]) | (places != places[start])
        order = np.argsort(chunk[late], kind="stable")
        h, check, chunk = h[late][order], check[late][order], chunk[late][order]
        cut = np.searchsorted(chunk, np.arange(len(parts) + 1))
        names = pdf["chunk"].tolist()
        return _rows([(names[k], h[cut[k] : cut[k + 1]].tobytes(), check[cut[k] : cut[k + 1]].tobytes()) for k in range(len(parts)) if cut[k] < cut[k + 1]], ["chunk", "hashes", "checks"])

    def kept(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in left.to_dict("records"):
            c = Chunk(r["ids"], r["sizes"], r["words"], r["codes"])
            gone = np.zeros(len(c.codes) + 1, c.number)
            if len(c.codes) >= min_words:
                h, check, start, at, k = firsts(c, np.flatnonzero(c.inside(min_words)), c.checks(min_words))
                elsewhere = np.zeros(len(h), bool)
                elsewhere[_find(h, check, gathered(right), gathered(right, "checks", "<u4"))] = True
                del h, check
                late = c.place_of(at) != c.place_of(start).take(k)
                late |= c.id_of(at) != c.id_of(start).take(k)
                late |= elsewhere.take(k)
                at = at[late]
                np.add.at(gone, at, 1)
                np.add.at(gone, at + min_words, -1)
            keep = np.cumsum(gone, out=gone)[: len(c.codes)] == 0
            before = 0
            for key, mark, end in zip(c.ids.tolist(), _unzip(r["marks"], "<i8").tolist(), c.end.tolist()):
                stay = c.codes[before:end][keep[before:end]]
                text = b" ".join([c.words[i] for i in stay])
                rows.append((key, mark, end - before, end - before - len(stay), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "surrogatepass")))
                before = end
        return _rows(rows, ["id", "text_hash", "n_words", "n_removed", "kept_sha256", "text"])

    several, n, paths = None, first, []
    while n < min_words:
        sent = "bucket int, chunk long, hashes binary"
        asked = chunks.mapInArrow(all_candidates, sent) if several is None else chunks.groupBy("chunk").cogroup(several.groupBy("chunk")).applyInPandas(candidates, sent)
        level, path = materialise(asked.groupBy("bucket").applyInPandas(in_several, "chunk long, hashes binary").withColumn("level", F.lit(n)), f"windows-{n}")
        paths.append(path)
        if level.isEmpty():  # nothing repeats in another chunk
            several = level
            break
        several, n = level if several is None else several.union(level), 2 * n
    whole = chunks.groupBy("chunk").cogroup(several.groupBy("chunk")).applyInPandas(wholes, "bucket int, chunk long, hashes binary, checks binary, ids binary, places binary")
    late, _ = materialise(whole.groupBy("bucket").applyInPandas(not_first, "chunk long, hashes binary, checks binary"), "windows")
    discard(spark, *paths)
    result = "id long, text_hash long, n_words long, n_removed long, kept_sha256 string, text string"
    out = chunks.groupBy("chunk").cogroup(late.groupBy("chunk")).applyInPandas(kept, result)
    without = source.where("id is null").mapInArrow(_unjudged, result)
    return out.union(without).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def _unjudged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [words_of(t.as_py()) for t in b.column(1)]
        text = [b" ".join(w) for w in words]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(w) for w in words], pa.int64()), pa.array([0] * len(words), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in text]), pa.array([t.decode("utf-8", "surrogatepass") for t in text], pa.string())], ["id", "text_hash", "n_words", "n_removed", "kept_sha256", "text"])
