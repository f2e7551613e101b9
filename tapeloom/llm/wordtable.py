"""Ids of many texts at once, for a tokenizer that drops white space: words are looked up side by side, as numbers."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain
from operator import attrgetter

import numpy as np

from .tokens import MARKS, SIGNS, UnitEncoder

ID = attrgetter("id")

SPACE, LETTER, MARK, OTHER = range(4)
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(9, 14), 32]] = SPACE
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[list(MARKS.encode())] = MARK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What follows byte C3 in a letter from U+00C0 to U+00FF, and in the small one of it.
TAIL = np.zeros(256, bool)
TAIL[128:192] = True
TAIL[[0x97, 0xB7]] = False  # the signs of multiplication and division
LOWER_TAIL = np.arange(256, dtype=np.uint8)
LOWER_TAIL[0x80:0x9F] += 32
#: A byte-level tokenizer's sign for each byte, as one UTF-16 unit.
SIGN = np.array([SIGNS.get(b, b) for b in range(256)], "<u2")
#: Words of up to so many bytes are kept as three numbers each.
WIDE = 24
FIRST = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)  # masks of the first k bytes
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class WordTable:
    """The ids of an encoder's texts. Words of up to WIDE bytes and what they are made of stay in a table of fixed size.

    Letters and the marks after them are units of their own; a word of any other form is one unit (see tokens.DROPS_SPACE). Each
    unit that the table does not hold is encoded once a batch by the encoder, which asks the tokenizers library. Units are compared
    by all their bytes. A unit takes the place of the one at its hash; after ``limit`` units the table is emptied, so memory is bounded.
    """

    def __init__(self, encoder: UnitEncoder, bits: int = 20, limit: int = 600_000):
        self.encoder, self.limit = encoder, limit
        self.shift = np.uint64(64 - bits)
        self.rows = np.zeros((1 << bits, 4), np.uint64)  # three numbers, then first id's place and number of ids
        self.flat, self.used, self.held = np.zeros(1 << 16, np.uint32), 0, 0

    def encode(self, texts: Iterable[bytes | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 texts in a row, each followed by ``end_id``, and how many each has; a null text is empty."""
        texts = [x or b"" for x in texts]
        enc, apart = self.encoder, {}
        if enc.whole or not enc.drops:
            apart = dict(enumerate(texts))
        elif any(a in b"\n".join(texts) for a in enc.literals):
            apart = {k: x for k, x in enumerate(texts) if any(a in x for a in enc.literals)}
        ids, sizes = self._plain([b"" if k in apart else x for k, x in enumerate(texts)])
        if apart:
            own = np.split(ids, np.cumsum(sizes)[:-1])
            for k, got in zip(apart, enc.encode(x.decode() for x in apart.values())):
                own[k] = np.frombuffer(got, "<u4")
            ids, sizes = np.concatenate(own), np.array([len(x) for x in own], np.int64)
        return np.insert(ids, np.cumsum(sizes), end_id), sizes + 1

    def _plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b" ".join(texts) + b" "
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        octets = np.frombuffer(raw + bytes(WIDE), np.uint8)
        start, stop, odd, small = self._units(octets, len(raw))
        if self.held > self.limit:
            self.rows[:] = 0
            self.used = self.held = 0
        far = stop - start > WIDE
        if b"\0" in raw:  # zero bytes are what the numbers are filled up with
            far |= odd
        keys = self._keys(small, start, stop)
        if len(some := np.flatnonzero(odd)):
            for key, own in zip(keys, self._keys(octets, start[some], stop[some])):
                key[some] = own
        mixed = (keys[0] * ODD[0]) ^ (keys[1] * ODD[1]) ^ (keys[2] * ODD[2])
        mixed = (mixed ^ (mixed >> np.uint64(32))) * ODD[1]
        slot = (mixed >> self.shift).view(np.int64)
        row = self.rows.take(slot, axis=0)
        known = (row[:, 0] == keys[0]) & (row[:, 1] == keys[1]) & (row[:, 2] == keys[2]) & ~far
        place = row[:, 3].view(np.int64) if len(row) else np.empty(0, np.int64)
        at, n = place >> 24, place & 0xFFFFFF
        fresh = np.flatnonzero(~known & ~far)
        if len(fresh):
            _, lead, which = np.unique(mixed[fresh], return_index=True, return_inverse=True)
            lead = fresh[lead]
            like = lead[which]
            differs = (keys[0][like] != keys[0][fresh]) | (keys[1][like] != keys[1][fresh]) | (keys[2][like] != keys[2][fresh])
            far[fresh[differs]] = True  # two units of one hash
            lead_at, lead_n = self._learn(small, raw, start[lead], stop[lead], odd[lead])
            at[fresh], n[fresh] = lead_at[which], lead_n[which]
            self.rows[slot[lead]] = np.stack([keys[0][lead], keys[1][lead], keys[2][lead], (lead_at << 24 | lead_n).view(np.uint64)], axis=1)
            self.held += len(lead)
        if len(some := np.flatnonzero(far)):
            got = [self.encoder.words[raw[i:j].decode()] for i, j in zip(start[some].tolist(), stop[some].tolist())]
            at[some], n[some] = self._add(got)
        sums = np.append(0, np.cumsum(n))
        ids = self.flat.take(np.repeat(at - sums[:-1], n) + np.arange(sums[-1]))
        return ids, np.diff(sums[np.searchsorted(start, np.append(0, np.cumsum(size)))])

    def _units(self, octets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of units in order, whether a unit is a word of another form than letters and marks, and the bytes in small letters."""
        kind, small = KIND.take(octets), LOWER.take(octets)
        lead = np.flatnonzero(octets[:length] == 0xC3)
        lead = lead[TAIL.take(octets[lead + 1])]
        kind[lead] = kind[lead + 1] = LETTER
        small[lead + 1] = LOWER_TAIL.take(octets[lead + 1])
        kind = kind[:length]
        run = np.append(0, np.flatnonzero(kind[1:] != kind[:-1]) + 1)
        of = kind.take(run)
        full = np.flatnonzero(of != SPACE)  # the last run is white space
        start, stop, of = run.take(full), run.take(full + 1), of.take(full)
        first = np.append(True, start[1:] != stop[:-1]) if len(full) else np.zeros(0, bool)
        odd = np.zeros(len(full), bool)
        bad = np.flatnonzero((of == OTHER) | ((of == LETTER) & ~first))
        if len(bad):
            head = np.flatnonzero(first)
            word = np.cumsum(first) - 1
            strange = np.unique(word[bad])
            last = np.append(head[1:], len(first)) - 1
            odd[head[strange]] = True
            stop[head[strange]] = stop[last[strange]]
            inside = np.zeros(len(head), bool)
            inside[strange] = True
            keep = np.flatnonzero(first | ~inside.take(word))
            start, stop, odd = start[keep], stop[keep], odd[keep]
        return start, stop, odd, small

    def _keys(self, octets: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
        """The first WIDE bytes of each unit as three numbers, filled up with zeros."""
        words = np.ndarray(len(octets) - 7, "<u8", octets, strides=(1,))
        size = stop - start
        out = []
        for k in range(0, WIDE, 8):
            key = words[np.minimum(start + k, len(words) - 1)]
            key &= FIRST.take(size - k, mode="clip")
            out.append(key)
        return out

    def _learn(self, small: np.ndarray, raw: bytes, start: np.ndarray, stop: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes units; where their ids are, and how many. Plain letters are one word to the tokenizer, so its model is asked at once."""
        at, n = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        other = odd | (KIND.take(small[start]) != LETTER)
        some = np.flatnonzero(other)
        at[some], n[some] = self._add([self.encoder.words[raw[i:j].decode()] for i, j in zip(start[some].tolist(), stop[some].tolist())])
        signs, some = SIGN.take(small).tobytes().decode("utf-16-le"), np.flatnonzero(~other)
        found = list(map(self.encoder.model, [signs[i:j] for i, j in zip(start[some].tolist(), stop[some].tolist())]))
        ids = np.fromiter(map(ID, chain.from_iterable(found)), np.uint32)
        at[some], n[some] = self._put(ids, np.fromiter(map(len, found), np.int64, len(found)))
        return at, n

    def _add(self, got: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, got), np.int64, len(got)) >> 2
        return self._put(np.frombuffer(b"".join(got), "<u4"), n)

    def _put(self, new: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.used + np.cumsum(n) - n
        while self.used + len(new) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.used : self.used + len(new)] = new
        self.used += len(new)
        return at, n
