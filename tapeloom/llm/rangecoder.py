"""An adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import zstandard

MAGIC = b"TLR3"
HEAD = struct.Struct("<4sIIIIII")  # magic, ids in a block, ids, blocks, length and crc32 of the prior, crc32 of the blocks' index
LOW32, HALF = np.uint64(0xFFFFFFFF), np.uint64(2**32)
W16, W32, FIELD = np.uint64(16), np.uint64(32), np.uint64(0xFFFF)
#: Order 2's slots in a block, and how often in a row a slot was right at first to be trusted so much (of 65536).
SLOTS, TRUST = 1024, (1500, 12000, 30000, 50000)
#: Order 1: bits of its division of the range, ids it may know followers of and followers it may know, and the bits that a
#: follower costs in the prior. Ids beyond are order 0's, so that tables stay bounded.
BITS1, CONTEXTS, FOLLOWERS, COST = 12, 2048, 4096, 14
#: Classes of contexts by how much of what follows order 1 knows; 0: nothing.
CLASSES = 8
#: Weights are 16-bit bounds of a division in three; each step they move by 2**-RATE towards what came true.
TOP, RATE = 65532, np.uint64(5)
CAP = np.uint64(TOP << 32)
_low, _inc = (1 << 16 - int(RATE)) - 1, TOP >> int(RATE)
KEPT = np.uint64(_low | _low << 16)
GAIN = np.array([_inc | _inc << 16, _inc << 16, 0], np.uint64)


def shares(counts: np.ndarray, group: np.ndarray, bits: int) -> np.ndarray:
    """Counts as whole parts, one at least, of 2**bits in each group; group: sorted numbers."""
    if not len(counts):
        return counts.astype(np.int64)
    lead = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(lead, len(group)))
    rate = ((1 << bits) - size) / np.add.reduceat(counts, lead)
    out = 1 + (counts * np.repeat(rate, size)).astype(np.int64)
    out[lead] += (1 << bits) - np.add.reduceat(out, lead)
    return out


def _planes(x: np.ndarray) -> bytes:
    """The bytes of integers by their place, since high bytes are mostly alike."""
    return np.ascontiguousarray(x.view("u1").reshape(-1, x.itemsize).T).tobytes()


class Prior:
    """What each block of a record starts from, stored in the record's head: its ids with their counts, and for frequent ids the
    followers that tell more than their own count does and their shares. Codes are the ids' ranks by count.

    size: number of followers of each of the first codes; follower, share1: theirs; unknown: how much else follows, of 255.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, size: np.ndarray, follower: np.ndarray, share1: np.ndarray, unknown: np.ndarray):
        self.ids, self.counts, self.size, self.follower, self.share1, self.unknown = ids, counts, size, follower, share1, unknown
        self.bits0 = max(16, len(ids).bit_length() + 2)
        self.share0 = shares(counts, np.zeros(len(ids), np.int64), self.bits0)
        self.start0 = np.cumsum(self.share0) - self.share0
        self.context = np.repeat(np.arange(len(size)), size)
        self.row = np.cumsum(size > 0) - 1  # of contexts with followers
        self.start1 = np.cumsum(share1) - share1 - (self.row[self.context] << BITS1)
        self.kind = np.zeros(len(ids), np.int64)
        self.kind[: len(size)] = np.where(size > 0, 1 + (unknown * (CLASSES - 1) >> 8), 0)

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple["Prior", np.ndarray]:
        """The prior of these ids, and their codes."""
        counts = np.bincount(ids)
        known = np.flatnonzero(counts)
        known = known[np.argsort(-counts[known], kind="stable")]
        rank = np.zeros(len(counts), np.int32)
        rank[known] = np.arange(len(known))
        codes, counts = rank.take(ids), counts[known]
        rows, wide = min(CONTEXTS, len(known)), min(FOLLOWERS, len(known))
        a, b = codes[:-1], codes[1:]
        both = np.flatnonzero((a < rows) & (b < wide))
        met = np.bincount(a[both] * np.int64(wide) + b[both], minlength=rows * wide)
        at = np.flatnonzero(met > 1)
        n, context, follower = met[at], at // wide, at % wide
        keep = n * np.log2(n * float(len(ids)) / (counts[context] * counts[follower].astype(float))) > COST
        n, context, follower = n[keep], context[keep], follower[keep]
        told = np.bincount(context, n, rows) / np.maximum(1, counts[:rows])
        unknown = np.clip(255 * (1 - told), 0, 255).astype(np.int64)
        return cls(known, counts, np.bincount(context, minlength=rows), follower, shares(n, context, BITS1), unknown), codes

    def pack(self) -> bytes:
        gap = np.diff(self.follower, prepend=0)
        lead = (np.cumsum(self.size) - self.size)[self.size > 0]
        gap[lead] = self.follower[lead]
        parts = [self.ids.astype("<u4"), self.counts.astype("<u4"), self.size.astype("<u2"), gap.astype("<u2"), self.share1.astype("<u2"), self.unknown.astype("u1")]
        return zstandard.ZstdCompressor(level=12).compress(struct.pack("<III", len(self.ids), len(self.size), len(gap)) + b"".join(map(_planes, parts)))

    @classmethod
    def unpack(cls, packed: bytes) -> "Prior":
        raw = zstandard.ZstdDecompressor().decompress(packed)
        n, rows, pairs = struct.unpack_from("<III", raw)
        at, parts = 12, []
        for kind, size in (("<u4", n), ("<u4", n), ("<u2", rows), ("<u2", pairs), ("<u2", pairs), ("u1", rows)):
            wide = np.dtype(kind).itemsize
            parts.append(np.ascontiguousarray(np.frombuffer(raw, "u1", size * wide, at).reshape(wide, size).T).view(kind).ravel().astype(np.int64))
            at += size * wide
        ids, counts, size, gap, share1, unknown = parts
        total = np.append(0, np.cumsum(gap))
        return cls(ids, counts, size, total[1:] - np.repeat(total[np.cumsum(size) - size], size), share1, unknown)


class Models:
    """The adaptive part, one lane a block; all lanes start alike, so a block needs no other.

    Order 2 remembers what followed a pair of codes last, and how often in a row that came true. How far it, order 1 and
    order 0 are trusted is learnt for each of its confidences and each class of context: these weights mix the three into
    one division of the coder's range.
    """

    def __init__(self, lanes: int, prior: Prior):
        lane = np.arange(lanes)
        self.kind = prior.kind << 2
        self.at_seen, self.at_mix = lane * SLOTS, lane * (4 * CLASSES)
        self.seen = np.zeros(lanes * SLOTS, np.int32)
        known = [0.02, *((CLASSES - c - 0.5) / (CLASSES - 1) for c in range(1, CLASSES))]
        self.mix = np.tile(np.array([t | int(t + (TOP - t) * k) << 16 for k in known for t in TRUST], np.uint64), lanes)
        self.last, self.slot = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def predict(self, n: int) -> None:
        self.place = self.at_seen[:n] + self.slot[:n]
        self.entry = self.seen.take(self.place)
        self.guess = self.entry >> 2
        self.mixed = self.kind.take(self.last[:n])
        self.mixed += self.entry & 3
        self.mixed += self.at_mix[:n]
        self.weights = self.mix.take(self.mixed)

    def bounds(self, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the chosen third: 0 is order 2, 1 order 1, 2 order 0."""
        shift = (by << 4).view(np.uint64)
        start = (self.weights << W16) >> shift
        start &= FIELD
        start += by.view(np.uint64)
        width = (self.weights | CAP) >> shift
        width &= FIELD
        width += (by + 1).view(np.uint64)
        width -= start
        return start, width

    def learn(self, x: np.ndarray, by: np.ndarray) -> None:
        n, e = len(x), self.entry
        moved = self.weights >> RATE
        moved &= KEPT
        np.subtract(self.weights, moved, out=moved)
        moved += GAIN.take(by)
        self.mix[self.mixed] = moved
        new = x << 2
        sure = np.flatnonzero(e & 2)
        new[sure] = e.take(sure) - 2
        right = np.flatnonzero(by == 0)
        old = e.take(right)
        new[right] = np.minimum(old + 1, old | 3)
        self.seen[self.place] = new
        slot, last = self.slot[:n], self.last[:n]
        np.multiply(last, 37, out=slot)
        np.copyto(last, x)
        slot ^= last * 5
        slot &= SLOTS - 1


def _lanes(n_ids: int, block: int) -> np.ndarray:
    """Block sizes; only the last is short, so lanes that are still at work are a prefix."""
    full, rest = divmod(n_ids, block)
    return np.array([block] * full + [rest] * (rest > 0), np.int64)


def encode(ids: np.ndarray, block: int = 2048) -> bytes:
    """Ids (under 2**22) as one record of blocks, which are coded side by side."""
    if len(ids) and int(np.max(ids)) >= 1 << 22:
        raise ValueError("ids are under 2**22")
    sizes = _lanes(len(ids), block)
    lanes = len(sizes)
    if not lanes:
        return HEAD.pack(MAGIC, block, 0, 0, 0, 0, 0)
    prior, codes = Prior.of(np.ascontiguousarray(ids, np.int32))
    grid = np.zeros((lanes, block), np.int32)
    grid.ravel()[: len(ids)] = codes
    grid = np.ascontiguousarray(grid.T)
    pairs = _followers(prior, grid)
    m = Models(lanes, prior)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    room = 2 * block + 4
    out, used = np.zeros(lanes * room, np.uint32), np.arange(lanes) * room
    start0, share0, start1, share1 = (x.astype(np.uint64) for x in (prior.start0, prior.share0, prior.start1, prior.share1))
    bits0, bits1 = np.uint64(prior.bits0), np.uint64(BITS1)

    def renew(small: np.ndarray) -> None:
        l, at = low[small], used[small]
        out[at] = l >> W32
        used[small] = at + 1
        l &= LOW32
        span[small] = np.minimum(span[small], HALF - l) << W32
        low[small] = l << W32

    for t in range(int(sizes[0])):
        n = lanes if t < sizes[-1] else lanes - 1
        x, pair = grid[t, :n], pairs[t, :n]
        m.predict(n)
        by = np.where(m.guess == x, 0, 2 - (pair >= 0))
        start, width = m.bounds(by)
        s = span[:n]
        s >>= W16
        start *= s
        low[:n] += start
        s *= width
        some = np.flatnonzero(by == 1)
        if len(some):
            k, part = pair.take(some), s.take(some) >> bits1
            low[some] += part * start1.take(k)
            s[some] = part * share1.take(k)
        some = np.flatnonzero(by == 2)
        if len(some):
            if prior.bits0 > 16:
                renew(some[s[some] <= LOW32])
            k, part = x.take(some), s.take(some) >> bits0
            low[some] += part * start0.take(k)
            s[some] = part * share0.take(k)
        small = np.flatnonzero(s <= LOW32)
        if len(small):
            renew(small)
        m.learn(x, by)
    out[used] = low >> W32
    out[used + 1] = low & LOW32
    words = used + 2 - np.arange(lanes) * room
    raw = np.ascontiguousarray(ids, "<u4")
    sums = np.array([zlib.crc32(raw[k * block : (k + 1) * block]) for k in range(lanes)], "<u4")
    packed, index = prior.pack(), words.astype("<u4").tobytes() + sums.tobytes()
    head = HEAD.pack(MAGIC, block, len(ids), lanes, len(packed), zlib.crc32(packed), zlib.crc32(index))
    return b"".join([head, packed, index, *(out[k * room : k * room + z].astype("<u4").tobytes() for k, z in enumerate(words.tolist()))])


def _followers(prior: Prior, grid: np.ndarray) -> np.ndarray:
    """Each code's place among order 1's followers of the code before it (of code 0 at a block's start), or -1."""
    rows, wide = len(prior.size), min(FOLLOWERS, len(prior.ids))
    place = np.full(rows * wide, -1, np.int32)
    place[prior.context * wide + prior.follower] = np.arange(len(prior.follower))
    out = np.empty(grid.shape, np.int32)
    for t in range(0, len(grid), 128):
        code = grid[t : t + 128]
        before = grid[t - 1 : t + 127] if t else np.concatenate([np.zeros_like(grid[:1]), grid[:127]])
        before = before[: len(code)]
        at = np.minimum(before, rows - 1) * np.int64(wide) + np.minimum(code, wide - 1)
        out[t : t + 128] = np.where((before < rows) & (code < wide), place.take(at), -1)
    return out


def decode(record: bytes) -> np.ndarray:
    """The ids of a record, after the head's and each block's checksum have been compared."""
    if len(record) < HEAD.size or record[:4] != MAGIC:
        raise ValueError("not a token record")
    _, block, n_ids, lanes, n_prior, prior_sum, index_sum = HEAD.unpack_from(record)
    if not lanes:
        return np.empty(0, np.uint32)
    at = HEAD.size + n_prior
    packed, index = record[HEAD.size : at], record[at : at + 8 * lanes]
    if zlib.crc32(packed) != prior_sum or zlib.crc32(index) != index_sum:
        raise ValueError("checksum of the head differs")
    prior = Prior.unpack(packed)
    used = np.frombuffer(index, "<u4", lanes).astype(np.int64)
    sums = np.frombuffer(index, "<u4", lanes, 4 * lanes)
    # a damaged block may ask for more words than it has; the checksum then tells
    words = np.concatenate([np.frombuffer(record, "<u4", offset=at + 8 * lanes), np.zeros(2 * block + 8, np.uint32)])
    place = np.cumsum(used) - used
    sizes = _lanes(n_ids, block)
    m = Models(lanes, prior)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    code = (words[place].astype(np.uint64) << W32) | words[place + 1]
    place += 2
    start0, share0, start1, share1 = (x.astype(np.uint64) for x in (prior.start0, prior.share0, prior.start1, prior.share1))
    bits0, bits1 = np.uint64(prior.bits0), np.uint64(BITS1)
    cells0 = np.repeat(np.arange(len(share0), dtype=np.int32), prior.share0) if prior.bits0 <= 20 else None
    cells1 = np.repeat(np.arange(len(share1), dtype=np.int32), prior.share1) if len(share1) else np.zeros(1, np.int32)
    row = np.zeros(len(prior.ids), np.int64)
    row[: len(prior.row)] = np.maximum(prior.row, 0) << BITS1
    follower = np.append(prior.follower, 0).astype(np.int32)
    grid = np.zeros((block, lanes), np.int32)

    def renew(small: np.ndarray) -> None:
        l, p = low[small] & LOW32, place[small]
        span[small] = np.minimum(span[small], HALF - l) << W32
        low[small] = l << W32
        code[small] = (code[small] << W32) | words.take(p, mode="clip")
        place[small] = p + 1

    def asked(some: np.ndarray, part: np.ndarray, bits: int) -> np.ndarray:
        v = (code.take(some) - low.take(some)) // np.maximum(part, 1)
        return np.minimum(v, np.uint64((1 << bits) - 1)).view(np.int64)

    for t in range(int(sizes[0])):
        n = lanes if t < sizes[-1] else lanes - 1
        m.predict(n)
        s = span[:n]
        s >>= W16
        v = (code[:n] - low[:n]) // s
        by = (v > (m.weights & FIELD)).astype(np.int64)
        by += v > ((m.weights >> W16) & FIELD) + np.uint64(1)
        start, width = m.bounds(by)
        start *= s
        low[:n] += start
        s *= width
        x = m.guess
        some = np.flatnonzero(by == 1)
        if len(some):
            part = s.take(some) >> bits1
            k = cells1.take(row.take(m.last.take(some)) + asked(some, part, BITS1), mode="clip")
            x[some] = follower.take(k)
            low[some] += part * start1.take(k, mode="clip")
            s[some] = part * share1.take(k, mode="clip")
        some = np.flatnonzero(by == 2)
        if len(some):
            if prior.bits0 > 16:
                renew(some[s[some] <= LOW32])
            part = s.take(some) >> bits0
            v = asked(some, part, prior.bits0)
            k = cells0.take(v) if cells0 is not None else np.searchsorted(prior.start0, v, "right") - 1
            x[some] = k
            low[some] += part * start0.take(k)
            s[some] = part * share0.take(k)
        small = np.flatnonzero(s <= LOW32)
        if len(small):
            renew(small)
        grid[t, :n] = x
        m.learn(x, by)
    ids = prior.ids.astype(np.uint32).take(np.ascontiguousarray(grid.T).ravel()[:n_ids], mode="clip")
    for k in range(lanes):
        if zlib.crc32(ids[k * block : (k + 1) * block]) != sums[k]:
            raise ValueError(f"checksum of block {k} differs")
    return ids
