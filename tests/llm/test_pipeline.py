"""The corpus pipeline's stages against brute force, each on its own input."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_nearcopies import brute as near_copies
from test_simhash import brute as near_groups
from test_substrings import brute as repeats
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tapeloom.llm import quality

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, key int"


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(9)
    vocab = [f"word{k}" for k in range(400)]
    passage = [rnd.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(60):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(5, 200))]
        if i % 4 == 0:
            w[3:3] = passage
        rows.append((i, "  ".join(w) + "\n", "en", f"s{i % 3}", 1000 + i, "x", i))
    rows += [(100 + k, rows[k][1], None, None, None, None, None) for k in range(5)]  # copies
    rows += [(200, None, "en", "s", 0, None, 1), (201, "", "en", "s", None, "y", 1), (202, "long " * 30000, "en", "s", 1, "y", 1), (None, "no id here", "en", "s", 1, "y", 1), rows[7]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def as_rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_quality_filter(spark, docs):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    kept = pipeline.quality_filter(spark, real, SF)
    assert kept.schema == real.schema or kept.columns == real.columns
    scores = quality.classify(real, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in scores.where("score >= 0.3").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stay = {r.doc_id for r in kept.select("doc_id").collect()}
    good, bad = [i for i in labels if labels[i]], [i for i in labels if not labels[i]]
    assert np.mean([i in stay for i in good]) > 0.98 and np.mean([i in stay for i in bad]) < 0.3
    out = pipeline.quality_filter(spark, docs, SF)
    assert out.columns == docs.columns and set(out.select("score").distinct().toPandas()["score"]) <= {"x", "y", None}


def test_near_dedup(spark, docs):
    rows = [(i, t) for i, t in as_rows(docs) if i is not None]
    groups = near_groups(dict(rows).items())
    out = pipeline.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((i, t) for i, t in as_rows(out) if i is not None) == sorted(((i, t) for i, t in rows if groups[i][1] == i))
    assert (None, "no id here") in as_rows(out)


def test_substring_dedup(spark, docs):
    out = pipeline.substring_dedup(spark, docs, SF)
    assert out.columns == docs.columns and out.count() == docs.count()
    before, after = dict(as_rows(docs)), {r.doc_id: r for r in out.collect()}
    gone = {i: n for i, _, n, _ in repeats(list(before.items()), 20)}
    for i, text in before.items():
        if gone[str(i)]:
            assert len(after[i].text.split()) == len(text.split()) - gone[str(i)] and after[i].n_chars == len(after[i].text)
        else:
            assert after[i].text == text
    assert sum(1 for n in gone.values() if n) > 10


def test_packing(spark, docs):
    out = pipeline.pack(spark, docs, SF)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in out.collect():
        pieces.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and 4 * r.length == len(r.ids)
    for i, text in dict(as_rows(docs)).items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        got = np.frombuffer(b"".join(r.ids for r in sorted(pieces[i], key=lambda r: r.start)), "<u4").tolist()
        assert got == ids or i == 7 and len(got) == 2 * len(ids)


def test_run_and_empty_tables(spark, docs):
    assert [name for name, _ in pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "substring dedup", "packing"]
    assert pipeline.run(spark, SF).agg(F.countDistinct("doc_id")).first()[0] > 500
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_matches_brute_force(spark):
    """All stages over documents: scores of the classifier, then all pairs, all windows and the library's ids."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in scored.where("score >= 0.3").collect()]
    component, links = near_copies(rows)
    rows = [(i, t) for i, t in rows if component[i] == i]
    digest = {i: (n, gone, sha) for i, n, gone, sha in repeats(rows, 20)}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in pipeline.run(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {i for i, _ in rows} and links
    for i, text in rows:
        ids = np.frombuffer(b"".join(r.ids for r in sorted(pieces[i], key=lambda r: r.start)), "<u4").tolist()
        assert ids[-1] == 1
        n, gone, sha = digest[str(i)]
        if gone:
            assert hashlib.sha256(t.decode(ids[:-1]).encode()).hexdigest() == sha
        else:
            assert ids == t.encode(text or "", add_special_tokens=False).ids + [1]
    assert sum(1 for _, gone, _ in digest.values() if gone) > 3
