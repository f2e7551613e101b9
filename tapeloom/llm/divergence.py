"""Divergence of sources within a language by hash-consed segment trees over term ids."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

#: Bytes of a text as the terms see them: A-Z in lower case, other ASCII but a-z as a blank, the rest as it is.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
PRICED = "source string, part string, item string, value long, terms long, zero long, kept long, lang string"


def _counted(entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, source, term, n, docs): occurrences, and documents that have the term; at most about ``entries`` are held."""
        counts: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0

        def made() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in counts.items():
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array(list(map(docs.__getitem__, n)), pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                terms = text.as_py().translate(FOLD).split()
                held -= len(n)
                n.update(terms)
                docs.update(set(terms))
                held += len(n)
                if held >= entries:
                    yield from made()
                    counts, held = {}, 0
        yield from made()

    return run


def share(counts: np.ndarray, prior: int, scale: int, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(scale * (counts + prior) / total), exact: scale is a power of 1000 and division goes three digits at a time."""
    rest = counts + prior
    out, rest = rest // total, rest % total
    while scale > 1:
        rest = rest * 1000
        out, rest, scale = out * 1000 + rest // total, rest % total, scale // 1000
    return 1 + out


class Trees:
    """One segment tree per row of ``counts`` (-1 pads); equal subtrees of any row at the same height are one node."""

    def __init__(self, counts: np.ndarray):
        self.values, nodes = np.unique(counts, return_inverse=True)
        nodes = nodes.reshape(counts.shape)
        self.children = []
        while nodes.shape[1] > 1:
            key, made = np.unique(nodes[:, ::2].astype(np.int64) << 32 | nodes[:, 1::2], return_inverse=True)
            self.children.append((key >> 32, key & 0xFFFFFFFF))
            nodes = made.reshape(len(counts), -1)
        self.roots = nodes[:, 0]

    def traverse(self, left: np.ndarray, right: np.ndarray):
        """Both trees of each pair (left[k], right[k]) at once, from the roots down; a pair of nodes is met once in a pair of trees.

        Gives (pair, node, node) of the distinct leaf pairs, and for each height from the leaves up where the left and the
        right child of each node pair are among those below.
        """
        pair, a, b = np.arange(len(left)), self.roots[left], self.roots[right]
        links = []
        for lows, highs in reversed(self.children):
            both = np.concatenate([pair, pair]) << 48 | np.concatenate([lows[a], highs[a]]) << 24 | np.concatenate([lows[b], highs[b]])
            key, at = np.unique(both, return_inverse=True)
            links.append((at[: len(pair)], at[len(pair) :]))
            pair, a, b = key >> 48, key >> 24 & 0xFFFFFF, key & 0xFFFFFF
        return (pair, a, b), links[::-1]


def _pricer(prior: int, scale: int, top: int, room: int):
    def price(rows: pd.DataFrame) -> pd.DataFrame:
        """The terms of one bucket of a language for the sources of one or two tiles."""
        groups = rows[rows["term"].isna()].sort_values("source")
        x, y, kept, lang = int(rows["x"].iloc[0]), int(rows["y"].iloc[0]), int(groups["kept"].iloc[0]), groups["lang"].iloc[0]
        names, tiles = groups["source"].tolist(), groups["own"].to_numpy()
        counted = rows[rows["term"].notna()]
        terms = counted.drop_duplicates("term").sort_values(["total", "term"], ascending=[False, True])[["term", "total"]]
        width = 1 << max(0, len(terms) - 1).bit_length()
        counts = np.full((len(names) + 1, width), -1, np.int64)  # the last row is the whole language
        counts[:, : len(terms)] = 0
        place = {t: k for k, t in enumerate(terms["term"])}
        row = {s: k for k, s in enumerate(names)}
        counts[counted["source"].map(row).to_numpy(int), counted["term"].map(place).to_numpy(int)] = counted["n"]
        counts[-1, : len(terms)] = terms["total"]
        sums = np.append(groups["n"].to_numpy(), groups["total"].iloc[0]) + prior * kept
        trees = Trees(counts)
        step = min(1 << 14, max(1, room // width))  # so that a pair and two nodes fit in 64 bits

        def leaves(left: np.ndarray, right: np.ndarray):
            (pair, a, b), links = trees.traverse(left, right)
            ca, cb = trees.values[a], trees.values[b]
            p, q = share(np.maximum(ca, 0), prior, scale, sums[left[pair]]), share(np.maximum(cb, 0), prior, scale, sums[right[pair]])
            f = (p - q) ** 2 // (p + q)
            return np.where(ca < 0, 0, f), np.where((ca > 0) & (p > q), f, -1), links

        out = []
        left, right = np.triu_indices(len(names), 1)
        if x != y:
            across = tiles[left] != tiles[right]
            left, right = left[across], right[across]
        for i in range(0, len(left), step):
            a, b = left[i : i + step], right[i : i + step]
            value = zero = np.zeros(len(a), np.int64)
            if kept:
                p, q = (share(np.zeros(len(a), np.int64), prior, scale, sums[k]) for k in (a, b))
                zero = (p - q) ** 2 // (p + q)
            if len(terms):
                value, _, links = leaves(a, b)
                for low, high in links:
                    value = value[low] + value[high]
            for one, other in ((a, b), (b, a)):
                out.append(pd.DataFrame({"source": [names[k] for k in one], "part": "pair", "item": [names[k] for k in other], "value": value, "terms": len(terms), "zero": zero}))
        if x == y and len(terms):
            spelled = terms["term"].to_numpy()
            order = np.argsort(np.argsort(spelled))
            for i in range(0, len(names), step):
                a = np.arange(i, min(i + step, len(names)))
                _, best, links = leaves(a, np.full(len(a), len(names)))
                heights = [best]
                for low, high in links:
                    heights.append(np.maximum(heights[-1][low], heights[-1][high]))
                pair, node, at = np.arange(len(a)), np.arange(len(a)), np.zeros(len(a), np.int64)
                for h in range(len(links) - 1, -1, -1):  # down to the leaves, leaving nodes whose best is under the top-th best
                    low, high = links[h]
                    pair, node, at = np.concatenate([pair, pair]), np.concatenate([low[node], high[node]]), np.concatenate([2 * at, 2 * at + 1])
                    near = _leading(pair, heights[h][node], top)
                    pair, node, at = pair[near], node[near], at[near]
                value = heights[0][node]
                pair, at, value = pair[value >= 0], at[value >= 0], value[value >= 0]
                near = np.lexsort((order[at], -value, pair))
                near = near[_rank(pair[near]) < top]
                out.append(pd.DataFrame({"source": [names[a[k]] for k in pair[near]], "part": "term", "item": [t.decode("utf-8", "replace") for t in spelled[at[near]]], "value": value[near], "terms": 0, "zero": 0}))
        if not out:
            return pd.DataFrame(columns=["source", "part", "item", "value", "terms", "zero", "kept", "lang"])
        return pd.concat(out).assign(kept=kept, lang=lang)

    return price


def _rank(keys: np.ndarray) -> np.ndarray:
    """Each row's place among those of its key, for sorted keys."""
    start = np.maximum.accumulate(np.where(np.append(True, keys[1:] != keys[:-1]), np.arange(len(keys)), 0)) if len(keys) else keys
    return np.arange(len(keys)) - start


def _leading(keys: np.ndarray, best: np.ndarray, top: int) -> np.ndarray:
    """Which rows are no worse than their key's top-th best; ties stay."""
    order = np.lexsort((-best, keys))
    last = np.full(int(keys.max(initial=0)) + 1, -1, np.int64)
    at = order[_rank(keys[order]) == top - 1]
    last[keys[at]] = best[at]
    return best >= np.maximum(last[keys], 0)


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 10, top: int = 10, prior: int = 2, scale: int = 10**9, bucket_terms: int = 2048, tile: int = 64, entries: int = 1 << 18, room: int = 1 << 19) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's terms are from those of its language's other sources.

    Terms are runs of letters (ASCII letters without case, and all other non-ASCII characters); a language keeps those in at
    least ``min_docs`` of its documents. A group (lang, source), and the whole language, gives each kept term the share
    p = 1 + floor(scale * (count + prior) / (N + prior * V)), N its kept terms' counts, V the number of kept terms. With
    f = floor((p - q)^2 / (p + q)), part "pair" has the sum of f over the kept terms for each other source of the language
    (0 without kept terms), and part "term" the group's ``top`` terms by f against the language, of those it has more of.
    Values are exact up to 9e15 counted terms a language. Ranks go by descending value, ties by item in UTF-8 order.

    Terms are counted in each task before they meet; a language's kept terms are dealt by hash into buckets of about
    ``bucket_terms``, its sources into tiles of about ``tile``. A task holds one bucket for the sources of two tiles: each source is
    a segment tree over the bucket's terms, equal subtrees share a node, and two trees are walked together, so that a
    pair of nodes is priced once. Sums over buckets give the pairs. A source's terms are found by walking down where the best
    price below is among the ``top``.

    Null lang, source or text is ''. Empty texts count as documents without terms; a group without terms still has its pairs.
    Texts of any length are taken whole. Repeated rows count each. An empty table gives no rows, a language with one
    source no pairs. Other columns are ignored, whatever their names.
    """
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    counted = source.mapInArrow(_counted(entries), "lang string, source string, term binary, n long, docs long")
    term = Window.partitionBy("lang", "term")
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    summed = summed.withColumn("docs", F.sum("docs").over(term)).where(F.col("docs") >= min_docs)
    first = F.row_number().over(term.orderBy("source")) == 1
    kept, kept_path = materialise(summed.select("lang", "term", "source", "n", F.sum("n").over(term).alias("total"), first.cast("long").alias("lead")), "terms")

    groups = source.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    groups, groups_path = materialise(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "groups")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("all"), F.count("*").alias("sources")).join(kept.groupBy("lang").agg(F.sum("lead").alias("kept")), "lang", "left")
    langs = langs.select("lang", "all", F.coalesce("kept", F.lit(0)).alias("kept"), F.ceil(F.col("sources") / tile).cast("int").alias("tiles"))
    langs, langs_path = materialise(langs.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("kept") / bucket_terms)).cast("int")), "langs")

    own = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("own")
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, "own").alias("x"), F.greatest(o, "own").alias("y")))).alias("t")
    bucket = F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket")
    counts = kept.join(langs, "lang").select("lang", bucket, own, "source", "term", "n", "total", "kept", "tiles")
    every = F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket")
    present = groups.join(langs, "lang").select("lang", every, own, "source", F.lit(None).cast("binary").alias("term"), "n", F.col("all").alias("total"), "kept", "tiles")
    dealt = counts.union(present).select("*", meet).select("lang", "bucket", "t.x", "t.y", "own", "source", "term", "n", "total", "kept")
    priced, _ = materialise(dealt.groupBy("lang", "bucket", "x", "y").applyInPandas(_pricer(prior, scale, top, room), PRICED), "priced")
    discard(docs.sparkSession, kept_path, groups_path, langs_path)

    pairs = priced.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg((F.sum("value") + F.max("zero") * (F.max("kept") - F.sum("terms"))).alias("value"))
    found = pairs.union(priced.where("part = 'term'").select("lang", "source", "part", "item", "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
