import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers

from tapeloom.llm import common, substrings, tokens


def chunk(n: int, docs: int) -> substrings.Chunk:
    rng = np.random.default_rng(5)
    words = b" ".join(b"w%d" % k for k in range(5_000))
    sizes = np.full(docs, n // docs, "<i8")
    codes = rng.integers(0, 5_000, n).astype("<i4")
    return substrings.Chunk(*(substrings._zip(x) for x in (np.arange(docs, dtype="<i8"), sizes, words, codes)))


def test_a_chunk_takes_few_bytes_a_word():
    n = 1 << 18
    tracemalloc.start()
    try:
        c = chunk(n, 64)
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        may = c.inside(10)
        at = c.anchors(10, may)
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert len(at) > n // 50
    assert peak / n < 48  # 66 with positions of 8 bytes and all at once


def test_operators_drop_what_earlier_ones_left_in_the_worker():
    spec = SimpleNamespace(value=open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    enc = tokens.encoder(spec)
    assert tokens.encoder(spec) is enc  # kept between tasks
    chunk(1 << 10, 4)
    assert not common.held
    assert tokens.encoder(spec) is not enc
