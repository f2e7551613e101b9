"""Byte-exact substring dedup: suffix arrays over the places that may repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, mix
from .suffixgroups import suffix_array

STRIPE = 1 << 19
CHUNKS = "chunk long, ids array<string>, sizes binary, text binary, starts binary, counts binary, anchors binary, cores binary"
PIECES = "core long, piece binary, n long, text binary, lead int, windows int"


def _zip(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x if isinstance(x, bytes) else x.tobytes())


def _unzip(x: bytes, kind: str | None = None):
    raw = zstandard.ZstdDecompressor().decompress(x)
    return np.frombuffer(raw, kind) if kind else raw


class Windows:
    """How windows of ``length`` bytes get anchors.

    A window's anchor is where the least hash is among those of its bytes from ``low`` to ``low + wide`` (the first of equal ones); so
    equal windows have their anchors at the same place. Windows in a row with one anchor are a segment, and share the ``core``
    bytes from ``reach`` before the anchor on.
    """

    def __init__(self, length: int):
        if length < 8:
            raise ValueError("windows have 8 bytes at least")
        self.length = length
        self.wide = 1 << (2 * length // 3).bit_length() - 1
        self.low = (length - self.wide) // 2
        self.gram = min(16, length - self.low - self.wide + 1)

    def core(self, lead_from: int, lead_to: int) -> tuple[int, int]:
        """Bytes around an anchor, as (before, after), that all windows have that begin lead_from to lead_to - 1 before it."""
        return lead_from, self.length - lead_to + 1

    def anchors(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that lie in one text each, and their anchors."""
        n = len(raw)
        padded = np.frombuffer(raw + bytes(32), np.uint8)
        starts, anchors = [], []
        doc_end = np.repeat(ends, np.diff(np.append(0, ends)))
        for i in range(0, n, STRIPE):
            j = min(i + STRIPE, n)
            own = np.flatnonzero(np.arange(i, j) + self.length <= doc_end[i:j])
            if not len(own):
                continue
            lo, hi = i + self.low, min(j + self.low + self.wide, n)
            h = self._hashes(padded, lo, hi)
            bits = int(len(h)).bit_length()
            best = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
            size = 1
            while size < self.wide:  # a power of two
                best = np.minimum(best[:-size], best[size:])
                size *= 2
            starts.append(own + i)
            anchors.append((best[own] & np.uint64((1 << bits) - 1)).astype(np.int64) + lo)
        none = np.empty(0, np.int64)
        return np.concatenate(starts) if starts else none, np.concatenate(anchors) if anchors else none

    def _hashes(self, padded: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """A hash of the ``gram`` bytes from each of lo .. hi - 1 on."""
        m = hi - lo

        def words(at: int) -> np.ndarray:
            part = padded[at : at + m + 8 + (-m) % 8]
            return np.stack([part[k : k + m + (-m) % 8].view("<u8") for k in range(8)], axis=1).ravel()[:m]

        first = words(lo)
        if self.gram < 8:
            return mix(first & np.uint64((1 << 8 * self.gram) - 1), np.uint64(11))
        return mix(first, words(lo + self.gram - 8))


def _chunked(windows: Windows, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts in chunks of about ``chunk_bytes`` with their segments; a text is in one chunk."""
        number = TaskContext.get().partitionId() << 32
        ids, parts, total = [], [], 0

        def made() -> pa.RecordBatch:
            raw = b"".join(parts)
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            at, anchor = windows.anchors(raw, np.cumsum(sizes))
            lead = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else np.empty(0, np.int64)
            counts = np.diff(np.append(lead, len(at)))
            before, after = windows.core(windows.low, windows.low + windows.wide)
            view = memoryview(raw)
            cores = np.array([xxhash.xxh3_64_intdigest(view[a - before : a + after]) for a in anchor[lead].tolist()], np.uint64)
            row = [[number], [ids], *([_zip(x)] for x in (sizes, raw, at[lead].astype("<i8"), counts.astype("<i4"), anchor[lead].astype("<i8"), cores))]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.list_(pa.string()), *[pa.binary()] * 6))], ["chunk", "ids", "sizes", "text", "starts", "counts", "anchors", "cores"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(key)
                parts.append(text.as_py())
                total += len(parts[-1])
                if total >= chunk_bytes:
                    yield made()
                    number += 1
                    ids, parts, total = [], [], 0
        if ids:
            yield made()

    return run


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, core, n) of each chunk's distinct cores."""
    for b in batches:
        for chunk, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            core, n = np.unique(_unzip(packed, "<u8"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(core), chunk)), pa.array(core.view(np.int64)), pa.array(n)], ["chunk", "core", "n"])


def _candidates(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A chunk's segments whose core repeats: where they are, and each distinct one once."""
    rows = []
    wanted = np.sort(right["core"].to_numpy(np.int64))
    for r in left.to_dict("records"):
        cores = _unzip(r["cores"], "<u8").view(np.int64)
        found = np.searchsorted(wanted, cores)
        keep = np.flatnonzero(wanted[np.minimum(found, len(wanted) - 1)] == cores) if len(wanted) else np.empty(0, np.int64)
        if not len(keep):
            continue
        raw, starts, counts, anchors = _unzip(r["text"]), _unzip(r["starts"], "<i8")[keep], _unzip(r["counts"], "<i4")[keep], _unzip(r["anchors"], "<i8")[keep]
        view, known, which = memoryview(raw), {}, np.empty(len(keep), np.int64)
        for k, (s, c) in enumerate(zip(starts.tolist(), counts.tolist())):
            which[k] = known.setdefault(xxhash.xxh3_128_digest(view[s : s + c - 1 + r["length"]]), len(known))
        first = np.unique(which, return_index=True)[1]
        text = b"".join([raw[s : s + c - 1 + r["length"]] for s, c in zip(starts[first].tolist(), counts[first].tolist())])
        rows.append((r["chunk"], _zip(starts), _zip(counts), _zip(which), list(known), _zip(np.bincount(which)), _zip(cores[keep][first]), _zip((anchors - starts)[first]), _zip(counts[first]), _zip(text)))
    return pd.DataFrame(rows, columns=["chunk", "starts", "counts", "which", "pieces", "n", "cores", "leads", "windows", "text"])


def _pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n, cores, leads, windows, text = _unzip(r["n"], "<i8"), _unzip(r["cores"], "<i8"), _unzip(r["leads"], "<i8"), _unzip(r["windows"], "<i4"), _unzip(r["text"])
                end = np.cumsum(windows.astype(np.int64) + length - 1).tolist()
                for i in range(0, len(n), 4096):
                    j = min(i + 4096, len(n))
                    texts = [text[a:z] for a, z in zip([0, *end][i:j], end[i:j])]
                    yield pa.RecordBatch.from_arrays([pa.array(cores[i:j]), pa.array(r["pieces"][i:j], pa.binary()), pa.array(n[i:j]), pa.array(texts, pa.binary()), pa.array(leads[i:j].astype(np.int32)), pa.array(windows[i:j].astype(np.int32))], ["core", "piece", "n", "text", "lead", "windows"])

    return run


def _halved(windows: Windows, wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of windows that begin in one of ranges of ``wide`` leads, cut in two; each part meets others by the longer core of its half."""
        for b in batches:
            rows = []
            for r in b.to_pylist():
                text, lead, last = r["text"], r["lead"], r["lead"] - r["windows"]  # leads go from lead down to last + 1
                low = windows.low + (lead - windows.low) // wide * wide
                for p in (low, low + wide // 2):
                    top, bottom = min(lead, p + wide // 2 - 1), max(last, p - 1)
                    if top <= bottom:
                        continue
                    at = lead - top
                    part = text[at : at + top - bottom - 1 + windows.length]
                    before, after = windows.core(p, p + wide // 2)
                    core = xxhash.xxh3_64_intdigest(text[lead - before : lead + after])
                    rows.append((core - (1 << 63), xxhash.xxh3_128_digest(part), r["n"], part, top, top - bottom, r["piece"], at))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int32()))], ["core", "piece", "n", "text", "lead", "windows", "of", "at"])

    return run


def _coded(texts: list[bytes], leads: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Texts that share bytes around their anchors as few symbols: (symbols, their bytes, text number, start), ends as -1 - number.

    Texts are cut wherever, seen from the anchor, two of them part, to either side, or one begins or ends. So two texts
    that differ in a symbol differ right where it begins, on the side away from the anchor, and no match ends inside one.
    """
    most = max(leads)
    right, left = [t[k:] for t, k in zip(texts, leads)], [t[:k][::-1] for t, k in zip(texts, leads)]
    cuts = {0, most}
    for side, sign in ((right, 1), (left, -1)):
        order = sorted(set(side))
        cuts.update(most + sign * len(x) for x in order)
        for a, b in zip(order, order[1:]):
            m = min(len(a), len(b))
            differ = np.flatnonzero(np.frombuffer(a, np.uint8, m) != np.frombuffer(b, np.uint8, m))
            cuts.add(most + sign * int(differ[0] if len(differ) else m))
    edges = sorted(cuts)
    known: dict[tuple[int, bytes], int] = {}
    codes, sizes, owner, at = [], [], [], []
    for k, (text, lead) in enumerate(zip(texts, leads)):
        shift = most - lead
        for i, j in zip(edges, edges[1:]):
            if i >= shift and j <= shift + len(text):
                codes.append(known.setdefault((i, text[i - shift : j - shift]), len(known)))
                sizes.append(j - i)
                owner.append(k)
                at.append(i - shift)
        codes.append(-1 - k)
        sizes.append(0)
        owner.append(k)
        at.append(len(text))
    return codes, sizes, owner, at


def repeated(groups: list[list[dict]], length: int) -> list[tuple[bytes, int, int]]:
    """(piece, first, end) of the windows of pieces (piece, text, lead, n) that another piece of their group has, too.

    One suffix array holds all groups, whose symbols differ; a suffix's longest match is with a neighbour of it.
    """
    codes, sizes, owner, at, rows = [], [], [], [], []
    for rs in groups:
        c, s, o, a = _coded([r["text"] for r in rs], [r["lead"] for r in rs])
        shift, ends = (max(codes, default=-1) + 1), len(rows)
        codes += [x + shift if x >= 0 else x - ends for x in c]
        sizes += s
        owner += [x + len(rows) for x in o]
        at += a
        rows += rs
    order = suffix_array(np.array(codes))
    n = len(codes)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    common, h = [0] * (n + 1), 0  # symbols that a suffix shares with the one before it in order
    for i in range(n):
        if k := rank[i]:
            j = order[k - 1]
            while i + h < n and j + h < n and codes[i + h] == codes[j + h]:
                h += 1
            common[k] = h
            h = max(0, h - 1)
        else:
            h = 0
    end = np.append(0, np.cumsum(sizes))
    place = np.arange(n)
    shared = np.array(common)
    most = np.maximum(shared[:-1], shared[1:])[np.array(rank)]
    match = end[place + most] - end[place]
    size, windows = np.array(sizes), np.array([r["windows"] for r in rows])
    first = np.array(at)
    stop = np.minimum(first + np.minimum(size, match - length + 1), windows[owner])
    found = np.flatnonzero((match >= length) & (size > 0) & (stop > first))
    return [(rows[owner[k]]["piece"], int(first[k]), int(stop[k])) for k in found]


def _grouped(length: int, at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by core; suffix arrays over whole groups of at least ``at_once`` pieces together."""
        held: list[dict] = []

        def made(rows: list[dict]) -> pa.RecordBatch:
            groups: dict[int, list[dict]] = {}
            for r in rows:
                groups.setdefault(r["core"], []).append(r)
            found = repeated(list(groups.values()), length)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else ([], [], []), (pa.binary(), pa.int32(), pa.int32()))], ["piece", "first", "stop"])

        for b in batches:
            held += b.to_pylist()
            while len(held) > at_once and held[at_once]["core"] != held[-1]["core"]:
                k = next(k for k in range(at_once, len(held)) if held[k]["core"] != held[k - 1]["core"])
                yield made(held[:k])
                held = held[k:]
        if held:
            yield made(held)

    return run


def _kept(length: int, with_text: bool):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in left.to_dict("records"):
            raw, sizes = _unzip(r["text"]), _unzip(r["sizes"], "<i8")
            gone = np.zeros(len(raw) + 1, np.int32)
            own = right[right["starts"].notna()]
            hits = right[right["piece"].notna()]
            if len(own) and len(hits):
                c = own.iloc[0]
                starts, which = _unzip(c["starts"], "<i8"), _unzip(c["which"], "<i8")
                order = np.argsort(which, kind="stable")
                cut = np.searchsorted(which[order], np.arange(len(c["pieces"]) + 1))
                number = {bytes(p): k for k, p in enumerate(c["pieces"])}
                k = hits["piece"].map(lambda p: number[bytes(p)]).to_numpy(np.int64)
                times = cut[k + 1] - cut[k]
                at = starts[order[np.repeat(cut[k] - np.cumsum(times) + times, times) + np.arange(times.sum())]]
                np.add.at(gone, at + np.repeat(hits["first"].to_numpy(np.int64), times), 1)
                np.add.at(gone, at + np.repeat(hits["stop"].to_numpy(np.int64), times) + length - 1, -1)
            stay = np.cumsum(gone[:-1]) == 0
            octets, end = np.frombuffer(raw, np.uint8), 0
            for key, size in zip(r["ids"], sizes.tolist()):
                mask = stay[end : end + size]
                kept = raw[end : end + size] if mask.all() else octets[end : end + size][mask].tobytes()
                runs = int(np.count_nonzero(mask[:-1] & ~mask[1:])) + int(size > 0 and not mask[0])
                out.append((key, size, size - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                end += size
        return pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 400, chunk_bytes: int = 4 << 20, group: int = 256, at_once: int = 512, with_text: bool = True) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept, the bytes that stay.

    A byte goes if a string of ``min_bytes`` bytes that covers it also starts anywhere else, in any document or in the same one;
    strings are judged on the input and don't cross documents. All copies go, the first included.

    Every window of ``min_bytes`` bytes has an anchor that depends on its bytes only; windows in a row with one anchor are a
    segment and share a core. Chunks of texts exchange their distinct cores; segments whose core is nowhere else hold no
    repeat. The others are collapsed by content (128 bits) and meet by core: one that occurs twice repeats as a whole, and
    different ones of a core go through a suffix array, which tells by neighbours which of their windows repeat. A core
    with over ``group`` different segments (a passage in a third of all documents has as many at its ends) is split: their
    windows are halved by place and meet again by the longer core of their half, until groups are small; a half that all
    share collapses to one row, one of a single document drops out. So no task holds a group of over ``group`` segments.

    A null or empty text has no bytes. Texts of any length are taken whole, each in one task's chunk. Null ids keep their rows, whose
    texts count like any other; so do repeated rows. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    windows = Windows(min_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    chunks, _ = materialise(source.mapInArrow(_chunked(windows, chunk_bytes), CHUNKS), "chunks", "uncompressed")

    cores = chunks.select("chunk", "cores").mapInArrow(_cores, "chunk long, core long, n long")
    cores = cores.withColumn("total", F.sum("n").over(Window.partitionBy("core"))).where("total > 1").select("chunk", "core")
    found = "chunk long, starts binary, counts binary, which binary, pieces array<binary>, n binary, cores binary, leads binary, windows binary, text binary"
    parts = chunks.select("chunk", "text", "starts", "counts", "anchors", "cores", F.lit(min_bytes).alias("length"))
    candidates, _ = materialise(parts.groupBy("chunk").cogroup(cores.groupBy("chunk")).applyInPandas(_candidates, found), "candidates", "uncompressed")

    def distinct(pieces: DataFrame, name: str) -> tuple[DataFrame, str]:
        return materialise(pieces.groupBy("core", "piece").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("text", "lead", "windows"))), name, "zstd")

    pieces, path = distinct(candidates.select("pieces", "n", "cores", "leads", "windows", "text").mapInArrow(_pieces(min_bytes), PIECES), "pieces")
    members, paths, hits, wide = None, [path], [], windows.wide
    while True:
        sizes = pieces.groupBy("core").agg(F.count("*").alias("different"))
        sized = pieces.join(sizes, "core")
        twice = pieces.where("n > 1").select("piece", F.lit(0).alias("first"), F.col("windows").alias("stop"))
        small = sized.where((F.col("different") > 1) & (F.col("different") <= group)).select("core", "piece", "text", "lead", "windows")
        arrays = small.repartition("core").sortWithinPartitions("core").mapInArrow(_grouped(min_bytes, at_once), "piece binary, first int, stop int")
        hit, path = materialise(twice.union(arrays), "repeats")
        paths.append(path)
        hits.append(hit if members is None else hit.join(members, "piece").select(F.col("of").alias("piece"), (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("stop")).alias("stop")))
        hot = sized.where(F.col("different") > group)
        if wide == 1 or hot.isEmpty():
            break
        split, path = materialise(hot.select("piece", "n", "text", "lead", "windows").mapInArrow(_halved(windows, wide), PIECES + ", of binary, at int"), "halves", "zstd")
        paths.append(path)
        made = split.select("piece", "of", "at").distinct()
        if members is not None:
            above = members.select(F.col("piece").alias("of"), F.col("of").alias("top"), F.col("at").alias("top_at"))
            made = made.join(above, "of").select("piece", F.col("top").alias("of"), (F.col("at") + F.col("top_at")).alias("at"))
        members, path = materialise(made, "members")
        paths.append(path)
        pieces, path = distinct(split, "pieces")
        paths.append(path)
        wide //= 2
    every = hits[0]
    for hit in hits[1:]:
        every = every.union(hit)
    holders = candidates.select("chunk", F.explode("pieces").alias("piece"))
    told, _ = materialise(every.join(holders, "piece").select("chunk", "piece", "first", "stop"), "told")
    discard(spark, *paths)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("starts", "binary"), ("which", "binary"), ("pieces", "array<binary>"))]
    where = candidates.select("chunk", "starts", "which", "pieces", *(F.lit(None).cast(t).alias(c) for c, t in (("piece", "binary"), ("first", "int"), ("stop", "int"))))
    right = where.union(told.select("chunk", *nothing, "piece", "first", "stop"))
    result = "id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = chunks.select("chunk", "ids", "sizes", "text").groupBy("chunk").cogroup(right.groupBy("chunk")).applyInPandas(_kept(min_bytes, with_text), result)
    out = out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept")
