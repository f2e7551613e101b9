"""Token ids of whole texts from a public tokenizer, with each distinct unit of a text encoded once per worker."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable
from itertools import chain
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import SparkSession

from .common import held

#: Unicode's White_Space, as tokenizers' \s has it (Python's \s has U+001C to U+001F besides).
SPACE = "\t-\r \x85\xa0  -     　"
#: Where a text may be cut so that its pieces encode as the whole does. For a byte-level BPE whose pre-tokenizer keeps
#: white space: a word with one blank before it, or a run of white space. For a BPE that drops white space: words. Both cut
#: a run of letters and digits from a mark that follows, which are never one token, so that fewer units are distinct.
PLAIN, MARKS = "a-zA-Z0-9À-ÖØ-öø-ÿ", ".,%#$&*!|"
LETTERS = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")
KEEPS_SPACE = re.compile(f" ?[{PLAIN}]+(?![^{SPACE}{MARKS}])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
DROPS_SPACE = re.compile(f"[{PLAIN}]+(?![^\t-\r {MARKS}])|[^\t-\r ]+")

#: A byte-level tokenizer's sign for each byte: visible Latin-1 characters stand for themselves, the rest for 256, 257, ... in order.
_shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _shown)}


class UnitCache:
    """Encodes texts unit by unit. Two generations of units are kept; the older goes when the newer holds ``limit``, which bounds memory, not results."""

    def __init__(self, limit: int = 600_000):
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.limit = limit

    def split(self, text: str) -> list[str]:
        """Units whose ids, joined, are the text's."""
        raise NotImplementedError

    def fresh(self, units: list[str]) -> Iterable[bytes]:
        """The ids of units that are not in the cache."""
        raise NotImplementedError

    def encode(self, texts: Iterable[str | None], chars: int = 1 << 20) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; a null text is empty."""
        out: list[bytes] = []
        some: list[list[str]] = []
        size = 0
        for text in texts:
            some.append(self.split(text or ""))
            size += len(text or "")
            if size >= chars:
                out += self._some(some)
                some, size = [], 0
        return out + self._some(some)

    def _some(self, texts: list[list[str]]) -> list[bytes]:
        new = set(chain.from_iterable(texts)).difference(self.cache)
        if len(self.cache) + len(new) > self.limit:
            self.older, self.cache = self.cache, {}
            new = set(chain.from_iterable(texts))
        ask = []
        for unit in new:
            if (known := self.older.get(unit)) is not None:
                self.cache[unit] = known
            else:
                ask.append(unit)
        self.cache.update(zip(ask, self.fresh(ask)))
        return [b"".join(map(self.cache.__getitem__, units)) for units in texts]


class Known(dict):
    """What ``make`` gave for each key. When ``limit`` keys are held they become the older generation, which goes at the next such
    turn: memory is bounded, results are not touched."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(key) > 100:  # rare, and large
            return got
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got


class UnitEncoder:
    """A tokenizer file of the tokenizers library; each distinct word is encoded once, from units that are.

    A text is cut at blanks (or at white space, if the tokenizer drops it), words into units, see KEEPS_SPACE. The file's
    added tokens (as ``<|endoftext|>``) are found first, as the library does by itself. ``special_as_text`` takes their
    strings as ordinary text instead.
    """

    def __init__(self, spec: str, limit: int = 400_000, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model.tokenize
        known = json.loads(spec)
        self.drops = '"Removed"' in json.dumps(known["pre_tokenizer"])
        self.cut = (DROPS_SPACE if self.drops else KEEPS_SPACE).findall
        added = [t for t in known.get("added_tokens", []) if not (special_as_text and t["special"])]
        self.whole = any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))  # these look beyond the token
        literals = sorted((re.escape(t["content"]) for t in added), key=len, reverse=True)
        self.literals = [t["content"].encode() for t in added]
        self.added = re.compile(f"({'|'.join(literals)})") if literals else None
        self.words = Known(self._word, limit)
        self.after_blank = Known(self._after_blank, limit)

    def _word(self, word: str) -> bytes:
        """The ids of a word or unit; plain letters are one word to each of these tokenizers, so their model is asked at once."""
        if word.isascii() and word.isalpha():
            return self._model(word.lower() if self.drops else word)
        if LETTERS.fullmatch(word):
            return self._model(self._signs(word.lower() if self.drops else word))
        units = self.cut(word)
        return self._ids(word) if len(units) < 2 else self._join(units)

    def _after_blank(self, word: str) -> bytes:
        """The ids of a word and one blank before it."""
        if LETTERS.fullmatch(word):
            return self._model(self._signs(" " + word))
        units = self.cut(" " + word)
        return self._ids(" " + word) if len(units) < 2 else self._join(units)

    def _join(self, units: list[str]) -> bytes:
        if self.drops:
            return b"".join(map(self.words.__getitem__, units))
        return b"".join([self.after_blank[u[1:]] if u[0] == " " and len(u) > 1 and u[1] != " " else self.words[u] for u in units])

    def _signs(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(SIGNS)

    def _model(self, signs: str) -> bytes:
        return array("I", [t.id for t in self.model(signs)]).tobytes()

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bytes:
        if self.drops:
            # white space to Python, but not to the tokenizer
            if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
                return self._join(self.cut(text))
            return b"".join(map(self.words.__getitem__, text.split()))
        if "  " in text or text.endswith(" "):  # a blank may belong to other white space
            return self._join(self.cut(text))
        words = text.split(" ")
        return self.words[words[0]] + b"".join(map(self.after_blank.__getitem__, words[1:]))

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; a null text is empty."""
        out = []
        for text in texts:
            if self.whole:
                out.append(self._ids(text or ""))
            elif self.added is None or len(parts := self.added.split(text or "")) == 1:
                out.append(self._plain(text or ""))
            else:
                out.append(b"".join(self._ids(part) if k % 2 else self._plain(part) for k, part in enumerate(parts)))
        return out


def share(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file's text for all executors; a vocabulary file's size does not depend on the input."""
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def encoder(spec: Broadcast) -> UnitEncoder:
    """This worker's encoder, kept between its tasks until another operator needs the memory."""
    if spec.value not in held:
        held[spec.value] = UnitEncoder(spec.value)
    return held[spec.value]
