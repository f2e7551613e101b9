import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tapeloom.llm import pieces, queries

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(PATH)


def test_matches_the_library(vocabulary):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rnd = random.Random(0)
    letters = "  ▁ \n\tabcdeinot.theéñß日本𠀀\x00<s>="
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    texts += ["", " ", "▁x", "a" * 3000, " " * 300, "the" * 900, "            x", "aaaa bbbb   cccc  ", "=" * 200, "<0x0A>", "</s>"]
    enc = pieces.PieceEncoder(vocabulary, limit=300)
    for t, want, got in zip(texts, sp.encode(texts, num_threads=1), enc.encode(texts, chars=3000)):
        assert np.frombuffer(got, "<u4").tolist() == want, t
        assert pieces.decode_ids(vocabulary, np.frombuffer(got, "<u4")) == sp.decode(want)
    assert pieces.decode_ids(vocabulary, np.array([258, 264])) == "� a" and pieces.decode_ids(vocabulary, np.array([1, 264])) == " a"


def test_suffix_array_and_ranges():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 4, 300)
    order = pieces.suffix_array(text, 8)
    rows = np.array([[1, 2, 0, 0], [3, 3, 3, 0], [2, 0, 0, 0], [1, 1, 2, 3], [9, 0, 0, 0]])
    low, high = pieces.occurrences(text, order, rows)
    for r, i, j in zip(rows, low, high):
        want = [x for x in r if x]
        assert sorted(order[i:j].tolist()) == [k for k in range(300) if text[k : k + len(want)].tolist() == want]


def test_query_on_the_whole_table(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {r.doc_id: r for r in queries.op5_sentencepiece(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = sp.encode(r.text)
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert g.text_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_edge_rows(spark, vocabulary):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a", 1), (3, "w " * 50000, 1), (3, "w", 2)], "doc_id long, text string, ids int")
    enc = pieces.encode(df, vocabulary)
    got = sorted(((str(r.doc_id), r.n_tokens, r.text) for r in pieces.decode(enc, vocabulary).collect()))
    assert got == [("1", 0, ""), ("2", 0, ""), ("3", 1, "w"), ("3", 50001, "w " * 50000), ("None", 1, "a")]
    both = pieces.encode(df, vocabulary, with_text=True)
    assert sorted((str(r.doc_id), r.n_tokens, r.text) for r in both.collect()) == got
    assert pieces.encode(df.limit(0), vocabulary).count() == 0
