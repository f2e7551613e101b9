"""Near copies by SimHash, confirmed by exact Jaccard similarity of word shingles; prefix filtering finds those that it misses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, let_go, materialise, mix, words_of
from .simhash import fingerprint, near_links

#: Two documents are near copies from a Jaccard similarity of LIKE[0] / LIKE[1] on.
LIKE = (4, 5)

#: Orders in which nodes of a key meet their next one before all meet: a large group of near copies becomes one component by them.
ORDERS = 16

#: Sets of more shingles have ``wide`` marks besides their ``brief`` ones, which tell little about them.
BRIEF = 512

#: Bins of ``wide`` marks.
WIDE = 4096


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted, distinct 64-bit hashes of a text's word shingles; fewer words than ``size``, or none, are one shingle."""
    words = words_of(text, lower=True)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh3_64_intdigest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(joined[i:j]) for i, j in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64))


def node_of(found: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def prefix(found: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which two sets share one at least if they are near copies: the first in the order (count, hash).

    Any order that all sets share will do; one that has frequent shingles last gives few candidates.
    """
    n = len(found)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
        found = found[np.lexsort((found, np.where(hot[at] == found, counts[at], 0)))]
    return found[: n - -(-n * LIKE[0] // LIKE[1]) + 1]


def parities(found: np.ndarray) -> np.ndarray:
    """The parity of the shingles in each of a power of two of bins, as bytes."""
    bins = 1 << min(16, max(8, (len(found) - 1).bit_length()))
    return np.packbits(np.bincount((found & np.uint64(bins - 1)).view(np.int64), minlength=bins) & 1, bitorder="little")


def brief(marks: bytes) -> np.ndarray:
    """Parities folded to 256 bins, as four words: a bound of what sets don't share, too, good for short texts."""
    words = np.frombuffer(marks, "<u8")
    while len(words) > 4:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words.view(np.int64)


def wide(found: np.ndarray) -> bytes | None:
    """The parities of a long set in ``WIDE`` bins, None for a short one."""
    if len(found) <= BRIEF:
        return None
    return np.packbits(np.bincount((found & np.uint64(WIDE - 1)).view(np.int64), minlength=WIDE) & 1, bitorder="little").tobytes()


def differ(x: bytes, y: bytes) -> int:
    """A lower bound of the shingles that two sets of these parities don't share: each one changes one bin."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _sets(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """(node, shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), size) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "node long, shingles binary")


def _frequent(docs: DataFrame, id_col: str, text_col: str, size: int, sample: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles frequent in a sample of documents (at most ``most``, sorted), their counts, and documents for each sampled one."""
    step = max(1, docs.count() // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(s.as_py(), "<i8"))], ["shingle"])

    some = _sets(docs.where(F.pmod(F.xxhash64(id_col), F.lit(step)) == 0), text_col, size).dropDuplicates(["node"])
    counted = some.select("shingles").mapInArrow(run, "shingle long").groupBy("shingle").count().where("count > 2")
    got = counted.orderBy(F.desc("count"), "shingle").limit(most).toArrow()
    hot, counts = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(hot)
    return hot[order], counts[order], step


def led_rows(key: np.ndarray, node: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Distinct pairs of each node with the first one of its key and size class, and with the next ones of its key in an order
    that hashes give, one of ``ORDERS`` by key; rows are sorted by key and n. At most two pairs a row.
    """
    size = np.floor(np.log(np.maximum(n, 1)) / np.log(LIKE[1] / LIKE[0]))
    lead = np.append(True, (key[1:] != key[:-1]) | (size[1:] != size[:-1]))[: len(key)]
    first = np.maximum.accumulate(np.where(lead, np.arange(len(key)), 0))
    order = np.lexsort((mix(node.view(np.uint64), key.view(np.uint64) % np.uint64(ORDERS)), key))
    x, y = order[:-1], order[1:]
    near = (key[x] == key[y]) & (np.minimum(n[x], n[y]) * LIKE[1] >= np.maximum(n[x], n[y]) * LIKE[0])
    a = np.concatenate([node[~lead], node[x[near]]])
    b = np.concatenate([node[first[~lead]], node[y[near]]])
    return np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)])[:, a != b], axis=1)


def _ranges(looks: np.ndarray, low: np.ndarray, high: np.ndarray, part: int) -> Iterator[tuple[int | np.ndarray, slice | np.ndarray]]:
    """Each of ``looks`` with its range of rows, low to high: a wide range alone as a slice, narrow ones together as pairs."""
    broad = high - low > 256
    for i, x, y in zip(looks[broad], low[broad].tolist(), high[broad].tolist()):
        yield i, slice(x, y)
    looks, low, size = looks[~broad], low[~broad], (high - low)[~broad]
    for k in range(0, len(looks), part // 256):
        own = size[k : k + part // 256]
        before = np.cumsum(own) - own
        yield np.repeat(looks[k : k + len(own)], own), np.arange(own.sum()) + np.repeat(low[k : k + len(own)] - before, own)


def close_parts(key: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray, *marks: np.ndarray, side: np.ndarray | None = None, wides: np.ndarray | None = None, part: int = 1 << 18) -> Iterator[np.ndarray]:
    """Parts of the pairs of nodes with a common key and different roots whose sizes, places, ``brief`` marks and, where both have
    some, ``wide`` marks allow near copies; rows are sorted by key and n.

    Only rows of a key's less common roots look for others, so a key of one root costs nothing. Where side is not 0, rows of
    side 1 look for those of side 2 only. If the key is the first shingle that both share, they share no more than follow its
    place (at) in either.
    """
    if not len(key):
        return
    side = np.zeros(len(key), np.int64) if side is None else side
    new = np.append(True, key[1:] != key[:-1])
    number = np.cumsum(new) - 1
    order = np.lexsort((root, number))
    first = np.append(True, (number[order][1:] != number[order][:-1]) | (root[order][1:] != root[order][:-1]))
    run = np.cumsum(first) - 1
    count = np.bincount(run)
    owner = number[order][first]
    best = np.lexsort((count, owner))
    best = best[np.append(owner[best][1:] != owner[best][:-1], True)]
    major = np.empty(len(key), bool)
    major[order] = np.isin(run, best)
    looks = np.flatnonzero((side == 1) | (side == 0) & ~major)
    far = int(n.max()) * LIKE[1] // LIKE[0] + 2
    place = number * far + n
    low = np.searchsorted(place, number[looks] * far - (-n[looks] * LIKE[0] // LIKE[1]))
    high = np.searchsorted(place, number[looks] * far + n[looks] * LIKE[1] // LIKE[0], "right")
    for i, j in _ranges(looks, low, high, part):
        # one row against a slice of rows, or pairs given one by one
        keep = root[i] != root[j]
        apart = np.zeros(len(keep), np.int16)
        for m in marks:
            apart += np.bitwise_count((m[i] ^ m[j]).view(np.uint64))
        keep &= apart.astype(np.int64) * sum(LIKE) <= (n[i] + n[j]) * (LIKE[1] - LIKE[0])
        if isinstance(j, slice):
            j = np.flatnonzero(keep) + j.start
            i = np.full(len(j), i)
        else:
            i, j = i[keep], j[keep]
        keep = np.where(side[i] == 1, side[j] == 2, (side[j] == 0) & (major[j] | (j > i)))
        both = n[i] + n[j]
        keep &= np.minimum(n[i] - at[i], n[j] - at[j]) * sum(LIKE) >= both * LIKE[0]
        i, j, both = i[keep], j[keep], both[keep]
        if wides is not None:
            known = np.flatnonzero((n[i] > BRIEF) & (n[j] > BRIEF))
            keep = np.ones(len(i), bool)
            for some in np.array_split(known, len(known) // 4096 + 1):
                apart = np.bitwise_count(wides[i[some]] ^ wides[j[some]]).sum(axis=1, dtype=np.int64)
                keep[some] = apart * sum(LIKE) <= both[some] * (LIKE[1] - LIKE[0])
            i, j = i[keep], j[keep]
        yield np.unique(np.stack([np.maximum(node[i], node[j]), np.minimum(node[i], node[j])]), axis=1)


def close_rows(key: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray, *marks: np.ndarray) -> np.ndarray:
    """The distinct pairs of ``close_parts``."""
    return np.unique(np.concatenate([np.empty((2, 0), np.int64), *close_parts(key, node, n, at, root, *marks)], axis=1), axis=1)


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by key, the first one, in parts that cut no key."""
    held = None
    for b in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        held = [np.concatenate(x) for x in zip(held, new)] if held else new
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if cut:
            yield [h[:cut] for h in held]
            held = [h[cut:] for h in held]
    if held and len(held[0]):
        yield held


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of ``led_rows`` within slices of keys, their key null, and the rows of all keys that two nodes may have, the
    node as a, b null."""
    names = ["a", "b", "key", "n", "at"]
    for cut, node, n, at, key in _whole_keys(batches):
        pairs = led_rows(cut, node, n)
        none = pa.nulls(pairs.shape[1], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), none, none, none], names)
        same = cut[1:] == cut[:-1]
        both = np.append(same, False) | np.append(False, same) | (cut != key)
        yield pa.RecordBatch.from_arrays([pa.array(node[both]), pa.nulls(int(both.sum()), pa.int64()), *(pa.array(c[both]) for c in (key, n, at))], names)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for *rows, side, marks in _whole_keys(batches):
        wides = np.frombuffer(b"".join(m or bytes(WIDE // 8) for m in marks), "<u8").reshape(len(marks), -1)
        for pairs in close_parts(*rows, side=side, wides=wides):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["a", "b"])


def _tiles(rows: DataFrame, tile: int) -> DataFrame:
    """Rows (key, node, n, at, root) of every key that has several roots, as (tile, node, n, at, root, side): keys of up to ``tile``
    rows whole; of larger ones the rows of the most common root and the others in slices by hash, each pair of slices with
    one of the others in it being a tile, side 1 against side 2, and each slice of the others with itself, side 0.
    """
    each = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    keys = each.groupBy("key").agg(F.sum("c").alias("total"), F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    mixed = rows.join(keys.select("key", "total", F.col("top.c").alias("most"), F.col("top.root").alias("common")), "key")
    main = F.col("root") == F.col("common")
    slices = lambda c: F.greatest(F.lit(1), F.ceil(c / F.lit(tile))).cast("int")
    others, mains = slices(F.col("total") - F.col("most")), slices(F.col("most"))
    own = F.pmod(F.xxhash64("node", "key"), F.when(main, mains).otherwise(others)).cast("int")
    upto = lambda c: F.sequence(F.lit(0), c - 1)
    one = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("long").alias("side"))
    nil = F.lit(0)
    among = F.transform(upto(others), lambda j: one(1, F.least(own, j), F.greatest(own, j), F.when(own == j, 0).when(own < j, 1).otherwise(2)))
    across = F.transform(upto(mains), lambda j: one(2, own, j, F.lit(1)))
    met = F.transform(upto(others), lambda i: one(2, i, own, F.lit(2)))
    dealt = F.when(F.col("total") <= tile, F.array(one(0, nil, nil, nil))).when(main, met).otherwise(F.concat(among, across))
    out = mixed.select("key", "node", "n", "at", "root", F.explode(dealt).alias("t"))
    return out.select(F.xxhash64("key", "t.kind", "t.i", "t.j").alias("tile"), "node", "n", "at", "root", "t.side")


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities allow near copies: at least so many shingles as ``differ`` says are not shared."""
    for b in batches:
        sizes = (b.column(2).to_numpy() + b.column(3).to_numpy()).tolist()
        keep = [differ(x.as_py(), y.as_py()) * sum(LIKE) <= n * (LIKE[1] - LIKE[0]) for x, y, n in zip(b.column(4), b.column(5), sizes)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both * sum(LIKE) >= (len(x) + len(y)) * LIKE[0])
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _by_fingerprint(nodes: DataFrame, radius: int, tile: int) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) that SimHash takes for near copies: those of one fingerprint with its first, the first ones of fingerprints that links join."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    same = nodes.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = near_links(first.select("fp"), radius, tile).toDF("x", "y").distinct()
    of = lambda fp, name: first.select(F.col("fp").alias(fp), F.col("first").alias(name))
    return same.union(links.join(of("x", "a"), "x").join(of("y", "b"), "y").select("a", "b"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, tile: int = 1024, sample: int = 8192, most: int = 1 << 18, radius: int = 2) -> DataFrame:
    """(id, component_id) of every row whose id is not null: documents link from a Jaccard similarity of 0.8 of their distinct
    word shingles on (A-Z lower-cased), and component_id is the smallest id that links reach.

    Equal sets are one node before. Nodes first meet by SimHash: those whose fingerprints are linked at ``radius`` differing bits or fewer are
    candidates (``simhash.near_links``), and what is confirmed among them is joined. It expects some ten differing bits at a similarity
    of 0.8, so what it leaves is looked up exactly.
    No pair is missed: near copies share a shingle of the prefixes that ``prefix`` picks, and rows meet by these shingles. A sample orders shingles, frequent ones last. Each node first meets the first one of a
    shingle and its next ones in a few orders, a frequent shingle's rows in slices of about ``tile``; each row is in one. What is
    confirmed among these is joined. Then nodes of a shingle that are still apart meet: shingles of one component drop out, and by
    exact counts larger ones are dealt as tiles, where only nodes outside the shingle's largest component look for others. So a
    large group of near copies costs what it has rows. Candidates that parities of bins don't rule out are confirmed on whole
    sets. Rows of a repeated id all count, each with its own text; an empty table gives no rows; other columns are ignored,
    whatever their names. A very long text is one row's work, linear in its length but for a sort. Shingles are compared by
    64-bit hashes. Blank texts, null ones among them, are alike.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull())
    kind = docs.schema[id_col].dataType.simpleString()
    hot, counts, step = _frequent(rows, id_col, text_col, size, sample, most)
    known = spark.sparkContext.broadcast((hot, counts))
    short = [f"m{i}" for i in range(4)]

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            sets = [shingles(t.as_py(), size) for t in b.column(1)]
            heads = [prefix(s, *known.value).tobytes() for s in sets]
            marks = [parities(s).tobytes() for s in sets]
            folded = np.array([brief(m) for m in marks], np.int64).reshape(-1, 4)
            columns = [b.column(0), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(heads, pa.binary()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([wide(s) for s in sets], pa.binary()), pa.array(np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)), *(pa.array(x) for x in folded.T.copy())], ["id", "node", "n", "head", "marks", "wide", "fp", *short])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, counts = known.value
        for b in batches:
            for node, n, head in zip(*(c.to_pylist() for c in b.columns)):
                key = np.frombuffer(head, "<u8")
                at = np.arange(len(key))
                slices = np.ones(len(key), np.int64)
                if len(hot):
                    k = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                    slices = np.where(hot[k] == key, -(-counts[k] * step // tile), 1)
                own = mix(key, np.uint64(node & (1 << 64) - 1)) % slices.astype(np.uint64)
                cut = np.where(slices > 1, mix(key, own), key).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cut), pa.array(np.full(len(key), node)), pa.array(np.full(len(key), n)), pa.array(at), pa.array(key.view(np.int64))], ["cut", "node", "n", "at", "key"])

    source = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints, prints_path = materialise(source.mapInArrow(printed, f"id {kind}, node long, n long, head binary, marks binary, wide binary, fp long, {', '.join(f'{m} long' for m in short)}"), "prints")
    nodes, nodes_path = materialise(prints.groupBy("node").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("head").alias("head"), F.first("marks").alias("marks"), F.first("wide").alias("wide"), F.min("fp").alias("fp"), *(F.first(m).alias(m) for m in short)), "sets")
    left, right = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("marks").alias("x")), nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("marks").alias("y"))

    def links_of(pairs: DataFrame) -> tuple[DataFrame, str]:
        """The near copies among pairs of nodes."""
        marked = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "x", "y")
        likely, likely_path = materialise(marked.mapInArrow(_likely, "a long, b long"), "likely")
        wanted = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct()
        texts = source.join(nodes.join(wanted, "node", "left_semi").select(F.col("first").alias("id")), "id", "left_semi")
        sets, sets_path = materialise(_sets(texts, "text", size).dropDuplicates(["node"]), "shingles")
        both = likely.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        links, links_path = materialise(both.mapInArrow(_confirm, "a long, b long"), "links")
        discard(spark, likely_path, sets_path)
        return links, links_path

    # nodes meet by fingerprint and few of their key only, then those that this has not joined meet each other
    dealt_rows = nodes.select("node", "n", "head").mapInArrow(dealt, "cut long, node long, n long, at long, key long")
    met, met_path = materialise(dealt_rows.repartition("cut").sortWithinPartitions("cut", "n", "node").mapInArrow(_lead, "a long, b long, key long, n long, at long"), "met")
    alike, alike_path = materialise(_by_fingerprint(nodes.select("node", "fp"), radius, tile), "alike")
    led, led_path = links_of(met.where("key is null").select("a", "b").union(alike).distinct())
    paths: list[str] = []
    stars, stars_path = materialise(connected_components(led, paths), "stars")
    roots = nodes.join(stars, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    shared, shared_path = materialise(met.where("key is not null").select("key", F.col("a").alias("node"), "n", "at").join(roots, "node").select("key", "node", "n", "at", "root"), "shared")
    apart = _tiles(shared, tile).join(nodes.select("node", "wide", *short), "node").select("tile", "node", "n", "at", "root", *short, "side", "wide")
    rest, rest_path = links_of(apart.repartition("tile").sortWithinPartitions("tile", "n", "node").mapInArrow(_close, "a long, b long").distinct())
    links = stars.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest)
    linked, linked_path = materialise(connected_components(links, paths).join(nodes, "node").select("node", "root", "first"), "linked")
    lowest = linked.groupBy("root").agg(F.min("first").alias("lowest"))
    merged = nodes.select("node", "first").join(linked.join(lowest, "root").select("node", "lowest"), "node", "left")
    out, _ = materialise(prints.select("id", "node").join(merged, "node").select(F.col("id").alias(id_col), F.coalesce("lowest", "first").alias("component_id")), "groups")
    discard(spark, prints_path, nodes_path, met_path, alike_path, led_path, stars_path, shared_path, rest_path, linked_path, *paths)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest id; rows with a null id stay.

    Rows that repeat an id stay or go together. Blank and null texts are one group; a text of any length is judged whole. An empty
    table gives no rows; all columns stay as they are, whatever their names.
    """
    gone = groups(docs, id_col, text_col, size).where(F.col(id_col) > F.col("component_id")).select(id_col)
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
