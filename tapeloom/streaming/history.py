"""Values of fields by sequence number in keyed state, found by range instead of by reading all of them."""

from __future__ import annotations

import json
from typing import Any, Protocol

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
NODE_KEY, NODE_VALUE = "level int, prefix long", "bits binary"
ROW_KEY, ROW_VALUE = "seq long", "fields string"


class KeyedState(Protocol):
    def getValue(self, key: tuple) -> tuple | None: ...
    def updateValue(self, key: tuple, value: tuple) -> None: ...
    def removeKey(self, key: tuple) -> None: ...


class History:
    """For each of ``fields``, values at sequence numbers: adds one, finds the last up to a number, drops one.

    Sequence numbers have eight bytes; a node for each prefix of bytes says, per field, which next bytes occur below. So every
    step reads at most some sixteen nodes, however many values there are. Nodes that a batch touches are read once and written
    once, by ``flush``.
    """

    def __init__(self, fields: tuple[str, ...], nodes: KeyedState, rows: KeyedState):
        self.fields, self.nodes, self.rows = fields, nodes, rows
        self.number = {f: k for k, f in enumerate(fields)}
        self.held: dict[tuple[int, int], list[int]] = {}
        self.changed: set[tuple[int, int]] = set()

    def _node(self, level: int, prefix: int) -> list[int]:
        key = (level, prefix)
        if key not in self.held:
            got = self.nodes.getValue(key)
            raw = bytes(got[0]) if got is not None else bytes(32 * len(self.fields))
            self.held[key] = [int.from_bytes(raw[32 * k : 32 * k + 32], "little") for k in range(len(self.fields))]
        return self.held[key]

    def _set(self, field: int, at: int, there: bool) -> None:
        for level in range(8):
            prefix, bit = at >> 8 * (level + 1), 1 << ((at >> 8 * level) & 255)
            node = self._node(level, prefix)
            before = node[field]
            node[field] = before | bit if there else before & ~bit
            if node[field] != before:
                self.changed.add((level, prefix))
            if before if there else node[field]:  # what is above knows of this node already, or has still to
                return

    def add(self, seq: int, values: dict[str, Any]) -> None:
        at = seq - LOWEST
        if any(self._node(0, at >> 8)[k] >> (at & 255) & 1 for k in range(len(self.fields))):
            values = self.at(seq) | values
        self.rows.updateValue((seq,), (json.dumps(values),))
        for field in values:
            self._set(self.number[field], at, True)

    def last(self, field: str, upto: int = HIGHEST) -> int | None:
        """The greatest number, ``upto`` at most, that has a value of the field."""
        k, at = self.number[field], upto - LOWEST
        for level in range(8):
            prefix, byte = at >> 8 * (level + 1), (at >> 8 * level) & 255
            below = self._node(level, prefix)[k] & ((1 << byte + (level == 0)) - 1)
            if below:
                at = prefix << 8 | below.bit_length() - 1
                for lower in range(level - 1, -1, -1):
                    at = at << 8 | self._node(lower, at)[k].bit_length() - 1
                return at + LOWEST
        return None

    def first(self, field: str, above: int) -> int | None:
        """The least number greater than ``above`` that has a value of the field."""
        k, at = self.number[field], above - LOWEST
        for level in range(8):
            prefix, byte = at >> 8 * (level + 1), (at >> 8 * level) & 255
            higher = self._node(level, prefix)[k] >> (byte + 1)
            if higher:
                at = prefix << 8 | byte + (higher & -higher).bit_length()
                for lower in range(level - 1, -1, -1):
                    bits = self._node(lower, at)[k]
                    at = at << 8 | (bits & -bits).bit_length() - 1
                return at + LOWEST
        return None

    def at(self, seq: int) -> dict[str, Any]:
        got = self.rows.getValue((seq,))
        return json.loads(got[0]) if got is not None else {}

    def drop(self, field: str, seq: int) -> None:
        at = seq - LOWEST
        self._set(self.number[field], at, False)
        if not any(bits >> (at & 255) & 1 for bits in self._node(0, at >> 8)):
            self.rows.removeKey((seq,))

    def drop_after(self, seq: int) -> None:
        """Drops every value at a greater number; each is visited once, when it goes."""
        for field in self.fields:
            while (s := self.last(field)) is not None and s > seq:
                self.drop(field, s)

    def drop_before(self, seq: int) -> None:
        """Of each field's values up to ``seq``, keeps the last."""
        for field in self.fields:
            kept = self.last(field, seq)
            while kept is not None and kept > LOWEST and (s := self.last(field, kept - 1)) is not None:
                self.drop(field, s)

    def flush(self) -> None:
        for level, prefix in self.changed:
            node = self.held[level, prefix]
            if any(node):
                self.nodes.updateValue((level, prefix), (b"".join(bits.to_bytes(32, "little") for bits in node),))
            else:
                self.nodes.removeKey((level, prefix))
        self.changed.clear()


class PagedHistory(History):
    """The same, with the values of up to ``page`` neighbouring numbers in one entry of the state.

    A page over a range of numbers holds its values itself until there are too many; then its sixteen sixteenths become pages, and
    it says, per field, which of them have values. A batch reads and writes each page that it touches once, so a key with fewer
    values than a page takes two calls a batch, others a few for each page's worth of values.
    """

    TOP = 16

    def __init__(self, fields: tuple[str, ...], pages: KeyedState, page: int = 256):
        self.fields, self.pages, self.page = fields, pages, page
        self.number = {f: k for k, f in enumerate(fields)}
        #: a page: values by number if it holds them itself, else a mask of sixteenths per field
        self.held: dict[tuple[int, int], dict[int, dict[str, Any]] | list[int]] = {}
        self.changed: set[tuple[int, int]] = set()

    def _page(self, level: int, prefix: int) -> dict[int, dict[str, Any]] | list[int]:
        key = (level, prefix)
        if key not in self.held:
            got = self.pages.getValue(key)
            held = json.loads(bytes(got[0])) if got is not None else {}
            self.held[key] = held if isinstance(held, list) else {int(n): v for n, v in held.items()}
        return self.held[key]

    def _leaf(self, at: int) -> tuple[int, dict[int, dict[str, Any]]]:
        """The level of the page that holds the values at a number, and these."""
        level = self.TOP
        while isinstance(page := self._page(level, at >> 4 * level), list):
            level -= 1
        return level, page

    def _mark(self, level: int, at: int, page: dict[int, dict[str, Any]], fields) -> None:
        """Tells the pages above whether values of these fields are left below."""
        for f in fields:
            k, there, up = self.number[f], any(f in v for v in page.values()), level
            while up < self.TOP:
                key, bit = (up + 1, at >> 4 * (up + 1)), 1 << ((at >> 4 * up) & 15)
                masks = self.held[key]
                before = masks[k]
                masks[k] = before | bit if there else before & ~bit
                if masks[k] != before:
                    self.changed.add(key)
                if masks[k] == before or (before if there else masks[k]):
                    break
                up += 1

    def _split(self, level: int, at: int, page: dict[int, dict[str, Any]]) -> None:
        while level > 1 and len(page) > self.page:
            masks, parts = [0] * len(self.fields), {}
            for n, values in page.items():
                part = n >> 4 * (level - 1)
                parts.setdefault(part, {})[n] = values
                for f in values:
                    masks[self.number[f]] |= 1 << (part & 15)
            self.held[level, at >> 4 * level] = masks
            for part, values in parts.items():
                self.held[level - 1, part] = values
                self.changed.add((level - 1, part))
            level -= 1
            page = self.held[level, at >> 4 * level]  # only the part of the newest value may be too large still

    def add(self, seq: int, values: dict[str, Any]) -> None:
        at = seq - LOWEST
        level, page = self._leaf(at)
        before = page.get(at)
        page[at] = values if before is None else before | values
        self.changed.add((level, at >> 4 * level))
        if level < self.TOP:
            above = self.held[level + 1, at >> 4 * (level + 1)]
            bit = (at >> 4 * level) & 15
            self._mark(level, at, page, [f for f in values if not above[self.number[f]] >> bit & 1])
        if len(page) > self.page:
            self._split(level, at, page)

    def at(self, seq: int) -> dict[str, Any]:
        return self._leaf(seq - LOWEST)[1].get(seq - LOWEST, {})

    def drop(self, field: str, seq: int) -> None:
        at = seq - LOWEST
        level, page = self._leaf(at)
        values = page.get(at, {})
        if field not in values:
            return
        rest = {f: v for f, v in values.items() if f != field}
        if rest:
            page[at] = rest
        else:
            del page[at]
        self.changed.add((level, at >> 4 * level))
        if level < self.TOP:
            self._mark(level, at, page, [field])

    def _end(self, field: str, level: int, prefix: int, greatest: bool) -> int | None:
        """The greatest or least number below a page that has the field."""
        k = self.number[field]
        while isinstance(page := self._page(level, prefix), list):
            bits = page[k]
            if not bits:
                return None
            prefix = prefix << 4 | (bits.bit_length() - 1 if greatest else (bits & -bits).bit_length() - 1)
            level -= 1
        return (max if greatest else min)((n for n, v in page.items() if field in v), default=None)

    def _near(self, field: str, at: int, greatest: bool) -> int | None:
        level, page = self._leaf(at)
        found = (max if greatest else min)((n for n, v in page.items() if field in v and (n <= at if greatest else n > at)), default=None)
        while found is None and level < self.TOP:
            part = (at >> 4 * level) & 15
            level += 1
            bits = self.held[level, at >> 4 * level][self.number[field]]
            bits = bits & ((1 << part) - 1) if greatest else bits >> (part + 1) << (part + 1)
            if bits:
                part = bits.bit_length() - 1 if greatest else (bits & -bits).bit_length() - 1
                found = self._end(field, level - 1, (at >> 4 * level) << 4 | part, greatest)
        return None if found is None else found + LOWEST

    def last(self, field: str, upto: int = HIGHEST) -> int | None:
        return self._near(field, upto - LOWEST, True)

    def first(self, field: str, above: int) -> int | None:
        return self._near(field, above - LOWEST, False)

    def drop_after(self, seq: int) -> None:
        """Drops every value at a greater number, a page at a time."""
        for field in self.fields:
            while (s := self.last(field)) is not None and s > seq:
                at = s - LOWEST
                level, page = self._leaf(at)
                gone = [n for n in page if n + LOWEST > seq]
                lost = {f for n in gone for f in page.pop(n)}
                self.changed.add((level, at >> 4 * level))
                if level < self.TOP:
                    self._mark(level, at, page, lost)

    def flush(self) -> None:
        for level, prefix in self.changed:
            page = self.held[level, prefix]
            if any(page) if isinstance(page, list) else page:
                self.pages.updateValue((level, prefix), (json.dumps(page, ensure_ascii=False, separators=(",", ":")).encode(),))
            else:
                self.pages.removeKey((level, prefix))
        self.changed.clear()
