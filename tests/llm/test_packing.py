import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tapeloom.llm import packing, queries, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def direct(path, text):
    t = Tokenizer.from_file(path)
    return t.encode(text or "", add_special_tokens=False).ids


def test_units_encode_as_the_whole_text():
    rnd = random.Random(0)
    specials = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext"]
    letters = " \t\n\r\x0b\x0c\x85\xa0 　 \x1c​ aAbB'stdllve're19é́̈ßΣς中,.!<|>\U0001f600"
    texts = ["".join(rnd.choice(letters) if rnd.random() < 0.9 else rnd.choice(specials) for _ in range(rnd.randrange(40))) for _ in range(6000)]
    texts += ["", None, "a <|endoftext|> b", "<|endoftext|>a <|startoftext|>", "<|endoftext|><|endoftext|>"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
        enc = tokens.UnitEncoder(open(public_tokenizers.path(name), encoding="utf-8").read(), limit=100)
        assert [np.frombuffer(g, "<u4").tolist() for g in enc.encode(texts)] == want


def test_difference_balances():
    rng = np.random.default_rng(1)
    for n, k in ((1, 3), (5, 8), (40, 1), (300, 7)):
        sizes = rng.integers(1, 100, n)
        sums = np.bincount(packing.difference(sizes, k), sizes, minlength=k)
        assert len(sums) == k and sums.sum() == sizes.sum()
        if n == 300:
            assert sums.max() - sums.min() <= 2
    way, ways = packing.windows(np.array([60, 60, 60]), 100)  # two windows would hold 120
    assert ways == 3 and sorted(way.tolist()) == [0, 1, 2]


def test_every_id_once_and_little_padding(spark):
    rnd = random.Random(2)
    words = ["alpha", "beta", "gam", "delta's", "99", "\n", "ö"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 50, 300, 3000])))) for i in range(400)]
    rows += [(900, None), (901, ""), (None, "null id"), (7, rows[7][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").coalesce(2)
    got = packing.pack(df, PATH, group=8).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    for i, t in rows:
        ids = direct(PATH, t) + [1]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(ids) * (2 if i == 7 else 1)
        if i != 7:
            assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == ids
            assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
    pad = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        pad += 2048 - at if at & (at - 1) else 0
    assert pad < 0.01 * sum(r.length for r in got)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_query_gives_the_library_ids(spark):
    sf = "/root/testdata/sf0.001"
    got = {}
    for r in queries.op10_packing(spark, sf).collect():
        got.setdefault(r.doc_id, []).append(r)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert set(got) == {d.doc_id for d in docs}
    for d in docs:
        ids, at = np.array(direct(PATH, d.text) + [1], "<u4"), 0
        for r in sorted(got[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_few_ids_are_in_powers_of_two_at_any_partitioning(spark):
    docs = spark.range(1500).selectExpr("id doc_id", "repeat(concat('some plain words ', id, ' here and more. '), cast(20 + id % 70 as int)) text")
    for n in (2, 64, 300):
        got = packing.pack(docs.repartition(n), PATH, with_ids=False, task_bytes=1 << 20)
        by_seq = {}
        for r in got.collect():
            by_seq[r.sequence_id] = by_seq.get(r.sequence_id, 0) + r.length
        total = sum(by_seq.values())
        assert sum(s for s in by_seq.values() if s & (s - 1) == 0 and s < 2048) < 0.01 * total
        assert sum(2048 - s for s in by_seq.values() if s & (s - 1)) < 0.01 * total
