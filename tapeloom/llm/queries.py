"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annforest, bytedups, common, divergence, lmscore, maintext, packing, pieces, quality, simhash, substrings, tokenfile, topk, turntrie


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scores = lmscore.score(docs, ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annforest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), with_text=True)
    return got.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("text_sha256"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/tapeloom-tokens-{uuid.uuid4().hex}"
    tokenfile.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return tokenfile.read(spark, path, with_ids=False)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("text", "text_hash")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytedups.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    return turntrie.trie_of(table(spark, sf_dir, "conversations"), base=conv - conv % 5, keep=F.crc32(conv.cast("string")) % 9)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_exact_topk": op2_exact_topk,
    "op3_lm_score": op3_lm_score,
    "op4_ann_forest": op4_ann_forest,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_token_file": op6_token_file,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_main_text": op8_main_text,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE: dict[str, str] = {
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        win AS (SELECT doc_id, s, array_to_string(ws[s + 1 : s + 20], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS s FROM d WHERE len(ws) >= 20)),
        firsts AS (SELECT k, min({'doc_id': doc_id, 's': s}) AS f FROM win GROUP BY k HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM win JOIN firsts USING (k) WHERE {'doc_id': doc_id, 's': s} > f),
        w AS (SELECT doc_id, p, ws[p + 1] AS word FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS p FROM d)),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op2_exact_topk": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM e q, e c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5""",
    "op12_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        w AS (SELECT id, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM (SELECT id, lang, source, unnest(ts) AS t FROM d)),
        kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
        c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
        g AS (
            SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY lang) AS lang_n FROM (SELECT DISTINCT lang, source FROM d)
            LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) USING (lang, source)),
        l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
        p AS (
            SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000 * CAST(coalesce(c.n, 0) + 2 AS HUGEINT)) // (g.n + 2 * v) AS p,
                1 + (1000000000 * CAST(l.n + 2 AS HUGEINT)) // (lang_n + 2 * v) AS q
            FROM g JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
                ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM (FROM pairs UNION ALL FROM terms)) WHERE part = 'pair' OR r <= 10""",
    "op13_prefix_trie": """
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
        lists AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
        crc AS (
            SELECT conv_id, conv_id - conv_id % 5 AS base, turns, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                lambda c: list_concat([CAST(ascii(c) AS BIGINT)], list_transform(range(8), lambda k: CAST(-1 AS BIGINT)))))),
                lambda r, c: CASE WHEN c >= 0 THEN xor(r, c) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END) AS r FROM lists),
        keep AS (SELECT conv_id, base, turns, xor(r, 4294967295) % 9 AS h FROM crc),
        made AS (SELECT k.conv_id, list_concat(coalesce(b.turns, [])[1 : h], k.turns[h + 1 :]) AS turns FROM keep k LEFT JOIN lists b ON k.base = b.conv_id),
        prefixes AS (SELECT conv_id, len(turns) AS n, d, turns[1 : d] AS p FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM made)),
        nodes AS (
            SELECT p, min(conv_id) AS conv_id, d AS depth, count(*) AS n_convs, coalesce(strlen(p[-1].text), 0) AS bytes, p[1 : d - 1] AS above,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM prefixes GROUP BY p, d),
        family AS (SELECT u.*, a.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children FROM nodes u LEFT JOIN nodes a ON u.depth > 0 AND a.p = u.above LEFT JOIN (SELECT above, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above) c ON c.above = u.p),
        inside AS (SELECT f.p[1 : a] AS p, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM (SELECT *, unnest(range(depth + 1)) AS a FROM family) f GROUP BY ALL)
        SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM family JOIN inside USING (p)""",
}
