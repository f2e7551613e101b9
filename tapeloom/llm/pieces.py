"""SentencePiece encoding and decoding by suffix-array matching."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import UnitCache

SPACE = "▁"
#: Where a text may be cut: no piece has white space after another character.
UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NONE = np.int64(1) << 40
CHARS = 0x110000


@dataclass
class Vocabulary:
    """A BPE model's pieces. Symbols are piece ids, and len(pieces) + code point for characters that are no piece."""

    pieces: list[bytes]  # what each id decodes to
    starts_blank: list[bool]
    byte_ids: list[int]
    edges: np.ndarray  # ids that can come out of encoding
    chars: np.ndarray  # code points + 1 of these, 0 after the end
    rank: np.ndarray  # when a piece is merged; -1 for single characters
    left: np.ndarray  # the two symbols that its last merge joins
    right: np.ndarray
    pairs: np.ndarray  # left * base + right of all joins, sorted
    pair_rank: np.ndarray

    @property
    def base(self) -> int:
        return len(self.pieces) + CHARS


def _last_merge(text: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The last of the merges that make the text one piece, best rank and then leftmost first; None if they don't."""
    parts, last = list(text), None
    while len(parts) > 1:
        best = min(((rank.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1)))
        if best[0] == NONE:
            return None
        i = best[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = ["".join(last)]
    return last


def load(path: str) -> Vocabulary:
    """The vocabulary of a BPE model file with byte fall-back and no normalization."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    if any(SPACE in names[i].lstrip(SPACE) for i in plain):
        raise ValueError("a piece has white space after another character")
    ids = {names[i]: i for i in plain}
    order = {s: k for k, s in enumerate(sorted({-sp.get_score(i) for i in plain}))}
    ranks = {names[i]: order[-sp.get_score(i)] for i in plain}
    symbol = lambda s: ids.get(s, n + ord(s) if len(s) == 1 else -1)
    rank, left, right = np.full(n, -1), np.full(n, -1), np.full(n, -1)
    joins, edges = {}, []
    for i in plain:
        s = names[i]
        if len(s) == 1:
            edges.append(i)
            continue
        rank[i] = ranks[s]
        for k in range(1, len(s)):
            if symbol(s[:k]) >= 0 and symbol(s[k:]) >= 0:
                joins[symbol(s[:k]) * (n + CHARS) + symbol(s[k:])] = ranks[s]
        if (last := _last_merge(s, ranks)) is not None:
            left[i], right[i] = symbol(last[0]), symbol(last[1])
            edges.append(i)
    width = max(len(names[i]) for i in plain)
    chars = np.zeros((len(edges), width), np.int64)
    for row, i in enumerate(edges):
        chars[row, : len(names[i])] = [ord(c) + 1 for c in names[i]]
    bytes_of = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    shown = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
    keys = np.array(sorted(joins), np.int64)
    return Vocabulary(shown, [names[i].startswith(SPACE) for i in range(n)], [bytes_of.get(b, 0) for b in range(256)], np.array(edges), chars, rank, left, right, keys, np.array([joins[k] for k in keys.tolist()], np.int64))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the text sorted by the next ``depth`` or more characters, by doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < depth:
        after = np.zeros_like(rank)
        after[:-k] = rank[k:] + 1
        rank = np.unique(rank * (len(text) + 2) + after, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return np.argsort(rank, kind="stable")


def occurrences(text: np.ndarray, order: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place in the suffix array of each piece, by binary search of one character after another."""
    padded = np.concatenate([text, np.zeros(chars.shape[1], text.dtype)])
    low, high = np.zeros(len(chars), np.int64), np.full(len(chars), len(text), np.int64)

    def bound(rows: np.ndarray, d: int, after: bool) -> np.ndarray:
        lo, hi, c = low[rows].copy(), high[rows].copy(), chars[rows, d]
        while len(on := np.flatnonzero(lo < hi)):
            mid = (lo[on] + hi[on]) // 2
            x = padded[order[mid] + d]
            go = x <= c[on] if after else x < c[on]
            lo[on[go]] = mid[go] + 1
            hi[on[~go]] = mid[~go]
        return lo

    for d in range(chars.shape[1]):
        rows = np.flatnonzero((chars[:, d] > 0) & (low < high))
        if not len(rows):
            break
        first, last = bound(rows, d, False), bound(rows, d, True)
        low[rows], high[rows] = first, last
    return low, high


class PieceEncoder(UnitCache):
    """Encodes batches of distinct units: all pieces are found in one suffix array, and edges are relaxed by position."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 300_000):
        super().__init__(limit)
        self.v = vocabulary
        self.single = set(self.v.chars[self.v.chars[:, 1] == 0, 0].tolist()) if self.v.chars.shape[1] > 1 else set(self.v.chars[:, 0].tolist())
        self.size = (self.v.chars > 0).sum(axis=1)

    def split(self, text: str) -> list[str]:
        return UNITS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def rank(self, symbols: np.ndarray) -> np.ndarray:
        n = len(self.v.rank)
        return np.where(symbols < n, self.v.rank[np.minimum(symbols, n - 1)], -1)

    def stay_apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether encoding leaves pieces x and y apart where y follows x.

        Undoes the merges of both from the last back. Where the symbols at the border could join before the merge that
        was undone (at the same rank the one further left comes first), they would have, and x and y would not both be.
        """
        x, y = x.copy(), y.copy()
        apart, limit, on = np.ones(len(x), bool), np.full(len(x), NONE), np.arange(len(x))
        while len(on):
            key = x[on] * self.v.base + y[on]
            at = np.minimum(np.searchsorted(self.v.pairs, key), len(self.v.pairs) - 1)
            joins = (self.v.pairs[at] == key) & (self.v.pair_rank[at] < limit[on])
            apart[on[joins]] = False
            on = on[~joins]
            rx, ry = self.rank(x[on]), self.rank(y[on])
            more = (rx >= 0) | (ry >= 0)
            on, rx, ry = on[more], rx[more], ry[more]
            of_x = rx > ry
            a, b = on[of_x], on[~of_x]
            limit[a], limit[b] = rx[of_x], ry[~of_x] + 1
            x[a], y[b] = self.v.right[x[a]], self.v.left[y[b]]
        return apart

    def fresh(self, units: list[str]) -> Iterable[bytes]:
        if not units:
            return []
        v, n = self.v, len(self.v.pieces)
        # code points + 1, a 0 after each unit
        raw = np.frombuffer("\0".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
        size = np.array([len(u) for u in units], np.int64)
        stop = np.cumsum(size + 1) - 1
        begin = stop - size
        text = np.append(raw + 1, np.int32(0))
        text[stop] = 0
        order = suffix_array(text, v.chars.shape[1]).astype(np.int32)
        low, high = occurrences(text, order, v.chars)
        found = high - low
        place = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low, found)
        start, piece, width = order[place], np.repeat(v.edges.astype(np.int32), found), np.repeat(self.size.astype(np.int32), found)
        del place
        known = np.zeros(len(text), bool)
        known[start[width == 1]] = True
        odd = np.flatnonzero(~known & (text > 0)).astype(np.int32)
        start, piece, width = np.concatenate([start, odd]), np.concatenate([piece, n + text[odd] - 1]), np.concatenate([width, np.ones(len(odd), np.int32)])
        base = np.repeat(begin, size + 1).astype(np.int32)
        end = start + width
        step = end - base[start]
        by = np.argsort(step.astype(np.int16) if step.max() < 2**15 else step, kind="stable")
        start, piece, end, step = start[by], piece[by], end[by], step[by]
        del by, width, known
        cut = np.searchsorted(step, np.arange(1, step[-1] + 2))
        last, back = np.full(len(text), -1), np.zeros(len(text), np.int64)
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            s, p, e = start[i:j], piece[i:j].astype(np.int64), end[i:j]
            before = last[s]
            open_ = s == base[s]
            ok = open_.copy()
            rest = np.flatnonzero(~open_)
            ok[rest] = self.stay_apart(before[rest], p[rest])
            last[e[ok]], back[e[ok]] = p[ok], s[ok]
        said, who, at, on = [], [], stop.copy(), np.arange(len(units))
        while len(on):
            said.append(last[at[on]])
            who.append(on)
            at[on] = back[at[on]]
            on = on[at[on] > begin[on]]
        said, who = np.concatenate(said)[::-1], np.concatenate(who)[::-1]
        by = np.argsort(who, kind="stable")
        ids, count = said[by], np.bincount(who, minlength=len(units))
        close = np.cumsum(count)
        odd_units = set(who[by][ids >= n].tolist())
        flat = np.minimum(ids, n).astype("<u4").tobytes()
        out = []
        for k, (i, j) in enumerate(zip((close - count).tolist(), close.tolist())):
            if k in odd_units:
                row = []
                for x in ids[i:j].tolist():
                    row += [x] if x < n else [v.byte_ids[b] for b in chr(x - n).encode("utf-8", "surrogatepass")]
                out.append(np.array(row, "<u4").tobytes())
            else:
                out.append(flat[4 * i : 4 * j])
        return out


_encoders: dict[int, PieceEncoder] = {}


def _encoder(shared: Broadcast) -> PieceEncoder:
    """This worker's encoder, kept between its tasks and queries of the same model."""
    key = zlib.crc32(b"\0".join(shared.value.pieces))
    if key not in _encoders:
        _encoders[key] = PieceEncoder(shared.value)
    return _encoders[key]


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    shown = b"".join([v.pieces[i] for i in ids.tolist()])
    if len(ids) and v.starts_blank[int(ids[0])]:
        shown = shown[1:]
    return shown.decode("utf-8", "replace")


def encode(docs: DataFrame, model: str | Vocabulary, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, ids, n_tokens): the ids of every whole text as little-endian 32-bit integers; a null or empty text has none.

    with_text adds the text that the ids decode to, from the same worker. One narrow stage; the model, of fixed size, is
    broadcast. Repeated rows and null ids stay; other columns are ignored, whatever their names. A text of any length is
    encoded whole, in time that grows with its length (some 0.1 ms a character of a stretch without blanks). An empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model) if isinstance(model, str) else model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                ids = enc.encode(some.column(1).to_pylist(), chars=2 << 20)
                columns = {"id": some.column(0), "ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
                if with_text:
                    columns["text"] = pa.array([decode_ids(enc.v, np.frombuffer(x, "<u4")) for x in ids], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"id {kind}, ids binary, n_tokens long" + ", text string" * with_text
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, model: str | Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, n_tokens, ids_crc32, text) of rows of ids, however many; null ids give an empty text.

    Repeated rows and rows with a null id stay; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(load(model) if isinstance(model, str) else model)
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x or b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array([decode_ids(shared.value, np.frombuffer(x, "<u4")) for x in raw], pa.string())],
                ["id", "n_tokens", "ids_crc32", "text"],
            )

    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, n_tokens long, ids_crc32 long, text string").withColumnRenamed("id", id_col)
