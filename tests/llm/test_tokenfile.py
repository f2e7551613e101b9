import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tapeloom.llm import queries, tokenfile
from tapeloom.llm.common import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip():
    rng = np.random.default_rng(0)
    walk = np.cumsum(rng.integers(0, 3, 9000)) % 700
    for ids in (np.empty(0, int), np.array([5]), rng.integers(0, 49408, 1000), rng.integers(0, 3, 20000), rng.integers(0, 1 << 22, 3000), np.zeros(20000, int), walk):
        for block in (1, 64, 8192) if len(ids) < 4000 else (64, 8192):
            record = tokenfile.encode(ids, block)
            assert (tokenfile.decode(record) == ids).all()
    assert 8 * len(tokenfile.encode(np.tile(walk[:50], 100))) < 5000  # repeats cost under a bit an id
    with pytest.raises(ValueError):
        tokenfile.encode(np.array([1 << 22]))


def test_damage_is_found_and_blocks_stand_alone():
    ids = np.random.default_rng(1).integers(0, 900, 1000)
    record = bytearray(tokenfile.encode(ids, 100))
    record[-7] ^= 64
    with pytest.raises(ValueError, match="checksum of block 9"):
        tokenfile.decode(bytes(record))
    head = bytearray(record)
    head[40] ^= 1
    with pytest.raises(ValueError, match="checksum of the head"):
        tokenfile.decode(bytes(head))
    with pytest.raises(ValueError, match="not a token record"):
        tokenfile.decode(b"x" * 40)


def test_files_in_order(spark):
    rnd = random.Random(4)
    words = ["Alpha", "beta", "don't", "42", "ö", "\n"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 30, 400])))) for i in rnd.sample(range(-50, 1000), 150)]
    rows += [(2000, None), (2001, ""), (2002, "long " * 20000), (None, "null id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int").repartition(5)
    path = f"{shared_dir(spark)}/tokens-test-{uuid.uuid4().hex}"
    tokenfile.write(df, path, PATH, segment=2000, block=128)
    got = tokenfile.read(spark, path).collect()
    t = Tokenizer.from_file(PATH)
    start = 0
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        r = by_id[i]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.start == start
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    repeated = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c")], "doc_id long, text string")
    tokenfile.write(repeated, path + "b", PATH)
    got = tokenfile.read(spark, path + "b", with_ids=False).collect()
    assert sorted((r.doc_id, r.start) for r in got) == [(1, 0), (1, 3), (2, 6)]
    tokenfile.write(df.limit(0), path + "c", PATH)
    assert tokenfile.read(spark, path + "c").count() == 0


def test_query_and_compression_on_the_whole_table(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    t = Tokenizer.from_file(PATH)
    want, start, every = [], 0, []
    for (i, _), e in zip(docs, t.encode_batch([text or "" for _, text in docs], add_special_tokens=False)):
        ids = np.array(e.ids + [1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
        every.append(ids)
    got = queries.op6_token_file(spark, "/root/testdata/sf0.01")
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == want
    ids = np.concatenate(every)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    entropy = -(share * np.log2(share)).sum()
    bits = 8 * len(tokenfile.encode(ids)) / len(ids)
    assert bits < 0.85 * entropy and bits < 0.8 * 8 * len(zlib.compress(ids.astype("<u2").tobytes())) / len(ids)


def test_rows_of_one_id_keep_their_order(spark):
    rows = [(5, f"text {k}") for k in range(60)] + [(4, "a"), (6, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for parts in (3, 7):
        path = f"{shared_dir(spark)}/tokens-test-{uuid.uuid4().hex}"
        tokenfile.write(df.repartition(parts), path, PATH)
        found.append(sorted((r.doc_id, r.start, bytes(r.ids)) for r in tokenfile.read(spark, path).collect()))
    assert found[0] == found[1] and len(found[0]) == len(rows)
