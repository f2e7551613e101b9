"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, mix

#: The end token; no word holds a line end.
END = b"\n"
PROBES = 4


class Tokens:
    """The tokens of some texts: words with A-Z in lower case, and an end after each text."""

    def __init__(self, texts: pa.Array | list[str | None]):
        if isinstance(texts, list):
            texts = pa.array([t and t.encode("utf-8", "surrogatepass") for t in texts], pa.binary()).view(pa.string())
        words = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts))  # white space is \x20 and \x09-\x0D; ends give empty words
        flat = words.flatten()
        real = pa.compute.greater(pa.compute.binary_length(flat), 0)
        held = flat.filter(real).dictionary_encode()
        stops = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        stops = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[stops]
        self.codes = np.insert(held.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, stops, 0)
        code = [END, *held.dictionary.cast(pa.binary()).to_pylist()]
        del words, flat, real, held
        pa.default_memory_pool().release_unused()  # else Arrow keeps some 30 MB for the next texts
        digest = xxhash.xxh3_128_digest
        both = np.frombuffer(b"".join([digest(w) for w in code]), "<u8").reshape(-1, 2)
        self.word, self.check = both[:, 0].copy(), both[:, 1].copy()
        self._bound()

    @classmethod
    def held(cls, codes: bytes, words: bytes, checks: bytes) -> "Tokens":
        """From the bytes of codes (32 bits) and of the words' hashes."""
        t = cls.__new__(cls)
        t.codes, t.word, t.check = np.frombuffer(codes, "<i4").astype(np.int64), np.frombuffer(words, "<u8"), np.frombuffer(checks, "<u8")
        t._bound()
        return t

    def _bound(self) -> None:
        self.stop = np.flatnonzero(self.codes == 0) + 1
        self.start = np.concatenate([[0], self.stop[:-1]]).astype(np.int64)

    def pairs(self) -> np.ndarray:
        """A hash of each token with the one before it; the first of a text follows an end."""
        before = np.concatenate([[0], self.codes[:-1]]).astype(np.int64)
        before[self.start] = 0
        return mix(self.word[before], self.word[self.codes]), before

    def distinct_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes of pairs in ascending order and their counts; numpy sorts when it is to count, which is faster than its hashing."""
        return np.unique(self.pairs()[0], return_counts=True)


def _texts(batches: Iterator[pa.RecordBatch], column: int, chars: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of batches with about ``chars`` characters, and their texts."""
    for b in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(size), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + chars, side="right")))
            part = b.slice(at, to - at)
            yield part, part.column(column)
            at = to


def _dealt(order: int, keys: np.ndarray, bins: int, *more: np.ndarray) -> Iterator[tuple]:
    """Rows (order, bin, keys, more ...) of sorted keys, dealt by their leading bits."""
    own = shard_of(keys, bins)
    cut = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(keys) else np.empty(0, np.int64)
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)]):
        yield (order, int(own[i]), keys[i:j].tobytes(), *(m[i:j].tobytes() for m in more))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key, by its leading bits."""
    return (keys >> np.uint64(64 - (shards.bit_length() - 1))).astype(np.int64) if shards > 1 else np.zeros(len(keys), np.int64)


def bins_of(shards: int) -> int:
    """Shards next to each other travel together as one of so many bins, up to eight shards in a bin.

    Every chunk of texts sends a row to every bin, so rows grow with the square of the input; a bin keeps them few.
    """
    return shards >> min(3, max(0, shards.bit_length() - 10))


def _numbers(column: pa.Array, kind: str) -> np.ndarray:
    """The numbers in all of a column's bytes, end to end."""
    column = column.cast(pa.binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, "<i4")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, "u1")[ends[0] : ends[-1]].copy().view(kind) if data else np.empty(0, kind)


def _bytes(numbers: np.ndarray, stops: np.ndarray) -> pa.Array:
    """A column of bytes: the numbers up to each stop from the one before it."""
    ends = np.append(0, stops * numbers.itemsize).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(numbers))])


def _runs(b: pa.RecordBatch, *columns: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows of a batch that follow each other with the same values of some columns."""
    values = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
    if b.num_rows:
        cut = np.flatnonzero(np.append(True, np.any([v[1:] != v[:-1] for v in values], axis=0))).tolist()
        for i, j in zip(cut, [*cut[1:], b.num_rows]):
            yield tuple(v[i].item() for v in values), b.slice(i, j - i)


def level_of(counts: np.ndarray) -> np.ndarray:
    """The quantised count: 1 + floor(log2 c), 0 for 0."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The mean count of a level: of 2**(j-1) to 2**j - 1."""
    return np.where(levels > 0, (2.0 ** (levels - 1) + 2.0**levels - 1) / 2, 0.0)


def _places(keys: np.ndarray, level: int | np.ndarray, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """The bit of each probe for the entry (key, level) in a filter of so many bits."""
    h = mix(keys, np.asarray(level, np.uint64))
    low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for _ in range(PROBES):
        yield ((low * np.asarray(bits, np.uint64)) >> np.uint64(32)).astype(np.int64)
        low = (low + step) & np.uint64(0xFFFFFFFF)


def _shards(pdf: pd.DataFrame, shards: dict[int, int], bits_per_entry: float) -> pd.DataFrame:
    """The counts of one bin's n-grams as the filters of its shards.

    Words are told apart by 128 bits and have exact counts too; the filter, whose answers are approximate anyway, knows
    n-grams by 64 bits.
    """
    order = int(pdf["ord"].iloc[0])
    keys = np.concatenate([np.frombuffer(k, "<u8") for k in pdf["keys"]])
    counts = np.concatenate([np.frombuffer(c, "<u4") for c in pdf["counts"]]).astype(np.int64)
    checks = np.concatenate([np.frombuffer(c, "<u8") for c in pdf["checks"]]) if order == 1 else np.zeros(len(keys), np.uint64)
    at = np.lexsort((checks, keys)) if order == 1 else np.argsort(keys)
    keys, checks = keys[at], checks[at]
    lead = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])))
    keys, checks, counts = keys[lead], checks[lead], np.add.reduceat(counts[at], lead)
    own = shard_of(keys, shards[order])
    cut = np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist()
    rows = [_shard(order, int(own[i]), keys[i:j], checks[i:j], counts[i:j], bits_per_entry) for i, j in zip(cut, [*cut[1:], len(own)])]
    return pd.DataFrame(rows, columns=FILTER_NAMES)


def _shard(order: int, shard: int, keys: np.ndarray, checks: np.ndarray, counts: np.ndarray, bits_per_entry: float) -> tuple:
    """One shard as a Bloom filter with an entry for each level up to the n-gram's own."""
    levels = level_of(counts)
    bits = int(levels.sum() * bits_per_entry + 64)
    if bits >= 1 << 32:
        raise ValueError("a shard of the filter holds under 2**32 bits; raise the number of shards")
    on = np.zeros(bits, bool)
    for j in range(1, int(levels.max()) + 1):
        for place in _places(keys[levels >= j], j, bits):
            on[place] = True
    exact = [keys.tobytes(), checks.tobytes(), counts.astype("<i8").tobytes()] if order == 1 else [b"", b"", b""]
    return order, shard, bits, np.packbits(on, bitorder="little").tobytes(), len(keys), int(counts.sum()), *exact


FILTER = "ord int, shard int, bits long, filter binary, distinct long, total long, keys binary, checks binary, counts binary"
FILTER_NAMES = [x.split()[0] for x in FILTER.split(", ")]


def probe(keys: np.ndarray, size: np.ndarray, byte: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The levels of n-grams: probed from 1 on, as far as entries are found.

    size, byte: the bits and first byte of the filter shard that each key belongs to.
    """
    found = np.zeros(len(keys), np.int64)
    at = np.flatnonzero(size > 0)
    level = 1
    while len(at):
        alive = np.ones(len(at), bool)
        for place in _places(keys[at], level, size[at]):
            alive &= ((data[byte[at] + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1).astype(bool)
        at = at[alive]
        found[at] = level
        level += 1
    return found


def exact(words: np.ndarray, checks: np.ndarray, keys: np.ndarray, key_checks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of words among keys that are sorted by key and check; words that share a key differ in the check."""
    if not len(keys):
        return np.zeros(len(words), np.int64)
    out = np.zeros(len(words), np.int64)
    at, open_ = np.searchsorted(keys, words), np.arange(len(words))
    while len(open_):
        place = np.minimum(at[open_], len(keys) - 1)
        same = (at[open_] < len(keys)) & (keys[place] == words[open_])
        hit = same & (key_checks[place] == checks[open_])
        out[open_[hit]] = counts[place[hit]]
        open_ = open_[same & ~hit]
        at[open_] += 1
    return out


def sums(t: Tokens, count: np.ndarray, level: np.ndarray, pair_level: np.ndarray, before: np.ndarray, total: int, distinct: int, power: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: tokens known, base score and model score.

    count, level: of each distinct word; pair_level: of each token with the one before it.
    """
    base = np.log10((count + 1) / (total + distinct + 1))[t.codes]
    single = count_of(level)
    history = single[before]
    pair = np.minimum(count_of(pair_level), history)
    flat = (single[t.codes] + 1) / (total + distinct + 1)
    types = (single**power)[before]
    model = np.log10(np.where(history > 0, (pair + types * flat) / np.maximum(history + types, 1e-300), flat))
    return tuple(np.add.reduceat(x, t.start) for x in ((count > 0)[t.codes].astype(np.int64), base, model))


@dataclass
class Whole:
    """All of the filter and the exact word counts, for one worker."""

    filters: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # order: bits and first byte of each shard, all bytes
    words: tuple[np.ndarray, np.ndarray, np.ndarray]
    total: int
    distinct: int

    def levels(self, order: int, keys: np.ndarray) -> np.ndarray:
        bits, first, data = self.filters[order]
        shard = shard_of(keys, len(bits))
        return probe(keys, bits[shard], first[shard], data)

    def score(self, t: Tokens, power: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs, before = t.pairs()
        pairs, at = np.unique(pairs, return_inverse=True)  # in ascending order, so one shard after another
        order = np.argsort(t.word)
        count, level = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        count[order], level[order] = exact(t.word[order], t.check[order], *self.words), self.levels(1, t.word[order])
        return sums(t, count, level, self.levels(2, pairs)[at], before, self.total, self.distinct, power)


def whole(filters: DataFrame, shards: dict[int, int], total: int, distinct: int) -> Whole:
    """Fetched shard by shard, so that the driver holds little more than the filter itself."""
    held, words = {}, {}
    for order in (1, 2):
        bits, first, parts, size = np.zeros(shards[order], np.int64), np.zeros(shards[order], np.int64), [], 0
        columns = ["shard", "bits", "filter", *(["keys", "checks", "counts"] if order == 1 else [])]
        for r in filters.where(f"ord = {order}").select(*columns).toLocalIterator():
            bits[r.shard], first[r.shard] = r.bits, size
            parts.append(np.frombuffer(r.filter, np.uint8))
            size += len(r.filter)
            if order == 1:
                words[r.shard] = r["keys"], r["checks"], r["counts"]
        held[order] = bits, first, np.concatenate(parts) if parts else np.zeros(1, np.uint8)
    sorted_words = [b"".join(x) for x in zip(*(words[k] for k in sorted(words)))] or [b""] * 3
    keys, checks, counts = map(np.frombuffer, sorted_words, ("<u8", "<u8", "<i8"))
    return Whole(held, (keys, checks, counts.astype("<u4") if total < 1 << 32 else counts), total, distinct)


class _Bin:
    """The filters of one bin's shards, and of words their exact counts, from the rows of FILTER."""

    def __init__(self, rows: list[dict], order: int, bin_: int, shards: int, bins: int):
        each = shards // bins
        self.order, self.shards, self.lead = order, shards, bin_ * each
        self.bits, self.first, parts, size = np.zeros(each, np.int64), np.zeros(each, np.int64), [], 0
        for r in rows:
            self.bits[r["shard"] - self.lead], self.first[r["shard"] - self.lead] = r["bits"], size
            parts.append(np.frombuffer(r["filter"], np.uint8))
            size += len(r["filter"])
        self.data = np.concatenate(parts) if parts else np.zeros(1, np.uint8)
        self.words = tuple(np.frombuffer(b"".join(r[c] for r in rows), kind) for c, kind in (("keys", "<u8"), ("checks", "<u8"), ("counts", "<i8")))

    def answers(self, keys: np.ndarray, checks: np.ndarray, some: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
        """The level of each key, and of words (key, check) the count; ``some`` at a time, whose arrays stay near the core."""
        level, count = np.zeros(len(keys), "u1"), np.zeros(len(keys) if self.order == 1 else 0, "<i8")
        for at in range(0, len(keys), some):
            k = keys[at : at + some]
            shard = shard_of(k, self.shards) - self.lead
            level[at : at + some] = probe(k, self.bits[shard], self.first[shard], self.data)
            if self.order == 1:
                count[at : at + some] = exact(k, checks[at : at + some], *self.words)
        return level, count


SCORES = "n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", bits_per_entry: float = 9.0, types_power: float = 0.9, max_bytes: int = 256 << 20, batch_chars: int = 4_000_000) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row's whole text, from the rows where ``training`` holds.

    base_score: add-one unigram log10 probability by exact counts. score: log10 of interpolated bigram probabilities
    (c(h,w) + t(h) p(w)) / (c(h) + t(h)), where c are levels found by probing the filter, p(w) is add-one over them and
    t(h) = c(h) ** types_power stands for the number of words seen after h.

    Counts go by hash to shards, each shard makes its part of the filter, and all parts are written to the shared folder.
    They are broadcast if they and the exact word counts together stay under ``max_bytes``. A larger filter is never
    collected: each chunk of texts sends its distinct n-grams to the shards and gets the levels back, which gives the
    same rows; a shard answers as questions stream by, so a task holds one shard or one chunk. No n-gram is left out.

    A null or empty text is its end token; texts of any length are scored whole (a chunk has one at least). Repeated rows
    count as often as they occur and are scored each; a null id keeps its row; other columns are ignored, whatever their
    names. No training rows: all counts are zero. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("learn"))
    chars = rows.where("learn").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = {1: 1 << max(2, (chars // 48_000_000).bit_length()), 2: 1 << max(3, (chars // 3_000_000).bit_length())}
    bins = {order: bins_of(n) for order, n in shards.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches, 0, batch_chars):
            t = Tokens(texts)
            order = np.argsort(t.word)
            n = np.bincount(t.codes, minlength=len(t.word)).astype("<u4")
            out = [*_dealt(1, t.word[order], bins[1], n[order], t.check[order])]
            pairs, n = t.distinct_pairs()
            out += [(*r, b"") for r in _dealt(2, pairs, bins[2], n.astype("<u4"))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["ord", "bin", "keys", "counts", "checks"])

    counted = rows.where("learn").select("text").mapInArrow(count, "ord int, bin int, keys binary, counts binary, checks binary")
    filters, filters_path = materialise(counted.groupBy("ord", "bin").applyInPandas(lambda pdf: _shards(pdf, shards, bits_per_entry), FILTER), "filters", "uncompressed")
    sizes = {r.ord: r for r in filters.groupBy("ord").agg(F.sum(F.length("filter")).alias("bytes"), F.sum("distinct").alias("distinct"), F.sum("total").alias("total")).collect()}
    total, distinct = (sizes[1].total, sizes[1].distinct) if sizes else (0, 0)
    held = None
    if sum(r.bytes for r in sizes.values()) + 24 * distinct <= max_bytes:
        held = spark.sparkContext.broadcast(whole(filters, shards, total, distinct))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in _texts(batches, 1, batch_chars // 4):
                t = Tokens(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(t.stop - t.start), *map(pa.array, held.value.score(t, types_power))], ["id", "n_tokens", "n_known", "base_score", "score"])

        found = rows.select("id", "text").mapInArrow(run, f"id {kind}, {SCORES}")
    else:
        found = _asked(rows.select("id", "text"), filters, shards, total, distinct, types_power, batch_chars, kind)
    out, _ = materialise(found, "scores")
    discard(spark, filters_path)
    if held is not None:
        held.destroy()
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _answers(batches: Iterator[pa.RecordBatch], shards: dict[int, int], bins: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """The levels and counts that chunks ask for, by bin and chunk; all questions of a batch to one bin are looked up at once."""
    own, mine, held = None, [], None
    for b in batches:
        for (order, bin_, asked), part in _runs(b.append_column("asked", pa.compute.greater_equal(b.column("chunk"), 0)), "ord", "bin", "asked"):
            if own != (order, bin_):  # a bin's filters come before its questions
                own, mine, held = (order, bin_), [], None
            if not asked:
                mine += part.to_pylist()
                continue
            held = held or _Bin(mine, order, bin_, shards[order], bins[order])
            level, count = held.answers(_numbers(part.column("keys"), "<u8"), _numbers(part.column("checks"), "<u8"))
            stops = np.cumsum(pa.compute.binary_length(part.column("keys")).to_numpy(zero_copy_only=False).astype(np.int64) // 8)
            yield pa.RecordBatch.from_arrays([part.column("chunk"), part.column("ord"), part.column("bin"), _bytes(level, stops), _bytes(count, stops if order == 1 else 0 * stops)], ["chunk", "ord", "bin", "levels", "counts"])


def _asked(rows: DataFrame, filters: DataFrame, shards: dict[int, int], total: int, distinct: int, power: float, chars: int, kind: str) -> DataFrame:
    """Scores by a filter that stays where it is: chunks of texts ask shards for their n-grams' levels."""

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part, texts in _texts(batches, 1, chars):
            t = Tokens(texts)
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([number]), ids, *(pa.array([x.tobytes()]) for x in (t.codes.astype("<i4"), t.word, t.check))], ["chunk", "ids", "codes", "words", "checks"])
            number += 1

    chunks, chunks_path = materialise(rows.mapInArrow(chunked, f"chunk long, ids array<{kind}>, codes binary, words binary, checks binary"), "texts", "zstd")

    bins = {order: bins_of(n) for order, n in shards.items()}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                t = Tokens.held(r["codes"], r["words"], r["checks"])
                order = np.argsort(t.word, kind="stable")
                out = [*_dealt(1, t.word[order], bins[1], t.check[order])]
                out += [(*x, b"") for x in _dealt(2, t.distinct_pairs()[0], bins[2])]
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array([r["chunk"]] * len(out)), pa.array(cols[2]), pa.array(cols[3])], ["ord", "bin", "chunk", "keys", "checks"])

    asks = chunks.select("chunk", "codes", "words", "checks").mapInArrow(ask, "ord int, bin int, chunk long, keys binary, checks binary")
    none = F.lit(None)
    bin_of = F.when(F.col("ord") == 1, F.floor(F.col("shard") / (shards[1] // bins[1]))).otherwise(F.floor(F.col("shard") / (shards[2] // bins[2])))
    theirs = filters.select("ord", bin_of.cast("int").alias("bin"), F.lit(-1).cast("long").alias("chunk"), "keys", "checks", "shard", "bits", "filter", "counts")
    both = theirs.unionByName(asks, allowMissingColumns=True)

    told = both.repartition("ord", "bin").sortWithinPartitions("ord", "bin", "chunk", "shard").mapInArrow(lambda batches: _answers(batches, shards, bins), "chunk long, ord int, bin int, levels binary, counts binary")
    text = chunks.select("chunk", F.lit(0).alias("ord"), F.lit(0).alias("bin"), none.cast("binary").alias("levels"), none.cast("binary").alias("counts"), "ids", "codes", "words", "checks")
    both = text.unionByName(told, allowMissingColumns=True)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, t, levels, counts = None, None, {1: [], 2: []}, []

        def made() -> pa.RecordBatch:
            order = np.argsort(t.word, kind="stable")
            count, level = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            count[order], level[order] = np.concatenate(counts), np.concatenate(levels[1])
            pairs, before = t.pairs()
            pair = np.concatenate(levels[2]).astype(np.int64)[np.unique(pairs, return_inverse=True)[1]]
            return pa.RecordBatch.from_arrays([ids, pa.array(t.stop - t.start), *map(pa.array, sums(t, count, level, pair, before, total, distinct, power))], ["id", "n_tokens", "n_known", "base_score", "score"])

        for b in batches:
            for (_, order), part in _runs(b, "chunk", "ord"):  # a chunk's texts come before its answers, which are in order of their keys
                if order == 0:
                    if t is not None:
                        yield made()
                    ids = part.column("ids")[0].values
                    t, levels, counts = Tokens.held(*(part.column(c)[0].as_py() for c in ("codes", "words", "checks"))), {1: [], 2: []}, []
                    continue
                levels[order].append(_numbers(part.column("levels"), "u1"))
                if order == 1:
                    counts.append(_numbers(part.column("counts"), "<i8"))
        if t is not None:
            yield made()

    return both.repartition("chunk").sortWithinPartitions("chunk", "ord", "bin").mapInArrow(finish, f"id {kind}, {SCORES}")
