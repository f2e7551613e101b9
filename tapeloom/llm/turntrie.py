"""Prefix trie of conversations by recursive halving of their depth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

ROOT = hashlib.sha256(b"root").digest()


def _joined_name(left: Column, right: Column) -> Column:
    """The name of two adjacent named stretches of turns; names have 32 bytes."""
    return F.unhex(F.sha2(F.concat(left, right), 256))


def numbered(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame, list[str]]:
    """(conv, pos, name, bytes) of every turn, (conv, len) of every conversation, and the paths of the tables that these read.

    Turns are in ascending order, a null order first, ties by role and then text; pos counts from 1. name stands for role
    and text (null: empty), bytes are those of the text. Rows with a null id have no conversation and are left out.

    Rows are dealt in ranges of (id, order, role, text), so that one conversation's turns may fill many tasks; each task
    numbers its own part, and the parts' sizes give the rest.
    """
    rows = turns.select(F.col(id_col).cast("long").alias("conv"), F.col(order_col).alias("at"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.where("conv is not null").repartitionByRange("conv", F.asc_nulls_first("at"), "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", F.asc_nulls_first("at"), "role", "text")
    name = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.select("conv", name.alias("name"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    rows, rows_path = materialise(rows.withColumn("part", F.shiftright("row", 33)), "turns")
    parts = rows.groupBy("conv", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts, parts_path = materialise(parts.withColumn("before", before), "parts")
    placed = rows.join(parts, ["conv", "part"]).select("conv", (F.col("before") + F.col("row") - F.col("first") + 1).alias("pos"), "name", "bytes")
    return placed, parts.groupBy("conv").agg(F.sum("n").alias("len")), [rows_path, parts_path]


def rebranched(placed: DataFrame, convs: DataFrame, base: Column, keep: Column) -> tuple[DataFrame, DataFrame, list[str]]:
    """Tables and paths as of ``numbered`` of conversations whose first turns are those of another one.

    base and keep are expressions of conv: a conversation gets the first ``keep`` turns of ``base`` (all if it has fewer, none if
    there is no such conversation), then its own turns after its first ``keep``.
    """
    plan = convs.select("conv", "len", base.alias("base"), keep.cast("long").alias("keep"))
    heads = convs.select(F.col("conv").alias("base"), F.col("len").alias("base_len"))
    head = F.least("keep", F.coalesce("base_len", F.lit(0)))
    plan = plan.join(heads, "base", "left").select("conv", "base", "keep", head.alias("head"), (head + F.greatest(F.col("len") - F.col("keep"), F.lit(0))).alias("len"))
    plan, plan_path = materialise(plan, "branches")
    own = placed.join(plan.select("conv", "keep", "head"), "conv").where("pos > keep").select("conv", (F.col("pos") - F.col("keep") + F.col("head")).alias("pos"), "name", "bytes")
    asked = plan.select(F.col("conv").alias("to"), F.col("base").alias("conv"), "keep")
    led = placed.join(asked, "conv").where("pos <= keep").select(F.col("to").alias("conv"), "pos", "name", "bytes")
    rows, rows_path = materialise(own.union(led), "branched")
    return rows, plan.select("conv", "len"), [rows_path, plan_path]


def _paths(placed: DataFrame, convs: DataFrame, levels: int) -> tuple[DataFrame, list[str]]:
    """(conv, d, len, name, parent, bytes): the names of each conversation's first d turns and of the d - 1 before.

    Up: blocks of 2^j turns are named from their halves. Down: a block whose preceding turns are named is cut in half, and
    what precedes the lower half is named from that and the upper half. All blocks of a height are cut at once.
    """
    paths, halves = [], []
    block = placed.select("conv", (F.col("pos") - 1).alias("i"), "name", "bytes")
    for j in range(levels):
        odd, side = F.col("i") % 2 == 1, F.shiftright("i", 1).alias("b")
        sides = [F.max(F.when(~odd, F.col("name"))).alias("low"), F.max(F.when(odd, F.col("name"))).alias("high")]
        sides += [F.max(F.when(~odd, F.col("bytes"))).alias("low_bytes"), F.max(F.when(odd, F.col("bytes"))).alias("high_bytes")] if not j else []
        pairs, path = materialise(block.groupBy("conv", side).agg(*sides), "pairs")
        paths.append(path)
        halves.append(pairs)
        block = pairs.where("high is not null").select("conv", F.col("b").alias("i"), _joined_name(F.col("low"), F.col("high")).alias("name"))
    known = convs.where("len > 0").select("conv", "len", F.lit(0).cast("long").alias("b"), F.lit(ROOT).alias("before"), F.lit(None).cast("binary").alias("after"))
    for j in range(levels - 1, -1, -1):
        cut = known.join(halves[j].drop("high"), ["conv", "b"], "left")
        cut = cut.withColumn("middle", F.when(F.col("low").isNotNull(), _joined_name(F.col("before"), F.col("low"))))
        low = [(F.col("b") * 2).alias("b"), F.col("before"), F.col("middle").alias("after")]
        high = [(F.col("b") * 2 + 1).alias("b"), F.col("middle").alias("before"), F.col("after")]
        if not j:  # the blocks are single turns
            low, high = [*low, F.col("low_bytes").alias("bytes")], [*high, F.col("high_bytes").alias("bytes")]
        children = cut.select("conv", "len", F.explode(F.array(F.struct(*low), F.struct(*high))).alias("c")).select("conv", "len", "c.*")
        known, path = materialise(children.where(F.col("b") * (1 << j) < F.col("len")), "known")
        paths.append(path)
    return known.select("conv", (F.col("b") + 1).alias("d"), "len", F.col("after").alias("name"), F.col("before").alias("parent"), "bytes"), paths


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of conversations that end at a node, as comma-joined lists of at most 2^16 ids; rows are sorted by node and id."""
    for b in batches:
        convs = b.column(1).to_pylist()
        nodes = b.column(0).to_pylist()
        cut = [0, *(k for k in range(1, len(nodes)) if nodes[k] != nodes[k - 1]), len(nodes)]
        cut = [k for i, j in zip(cut, cut[1:]) for k in range(i, j, 1 << 16)] + [len(nodes)]
        runs = [(nodes[i], convs[i], ",".join(map(str, convs[i:j])).encode()) for i, j in zip(cut, cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*runs) if runs else ([], [], []), (pa.binary(), pa.int64(), pa.binary()))], ["name", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's whole list, whose parts stream by in order."""
    node, digest = None, None
    for b in batches:
        done = []
        for name, ids in zip(b.column(0).to_pylist(), b.column(2)):
            if name == node:
                digest.update(b",")
            else:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = name, hashlib.sha256()
            digest.update(ids.as_py())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([h for _, h in done])], ["name", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], ["name", "ends_sha256"])


def _ends(ended: DataFrame) -> DataFrame:
    """(name, ends_sha256) of nodes at which conversations (name, conv) end; a hot node's ids are joined in many tasks first."""
    parts = ended.repartitionByRange("name", "conv").sortWithinPartitions("name", "conv").mapInArrow(_listed, "name binary, first long, ids binary")
    return parts.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_digested, "name binary, ends_sha256 string")


def prefix_trie(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of all conversations, from tables as of ``numbered``: one row per distinct sequence of first turns.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves (childless
    nodes of its subtree, which includes itself), saved_tokens (over its subtree, each node's n_convs - 1 times its last text's
    bytes), ends_sha256 (of the comma-joined ascending ids of members that end there). The root is there unless there is no
    conversation at all, in which case there are no rows; conversations without turns are its members only. Conversations of
    equal turns share all their nodes.

    Depths are halved recursively, all pieces of a height at once: prefixes at the cuts get names (SHA-256 of what they
    consist of), which separates the upper trie from the forest under each cut. Totals are grafted the same way: first each
    piece's from its halves, upwards, then downwards what hangs below each piece. A level handles half as many turns as
    the one before, so all levels together shuffle a small multiple of the input, and the number of levels is the logarithm
    of the depth. Every step is an aggregate with map-side combination or an equi-join; a node with a third of all
    members is a hot key of such steps only.
    """
    depth = convs.agg(F.max("len")).first()[0]
    if depth is None:
        return placed.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    levels = max(1, depth.bit_length())  # 2^levels > depth
    turns, paths = _paths(placed, convs, levels)
    nodes = turns.groupBy("name", "parent", "d", "bytes").agg(F.min("conv").alias("rep"), F.count("*").alias("n"))
    children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("children"))
    x = F.col("d") - 1
    height = F.when(x == 0, F.lit(levels)).otherwise(F.bit_count(x.bitwiseAND(-x) - 1))  # the highest pieces it is a root of
    nodes = nodes.join(children, "name", "left").select("name", "parent", "d", "rep", "n", F.coalesce("children", F.lit(0)).cast("long").alias("children"), ((F.col("n") - 1) * F.col("bytes")).alias("saved"), height.cast("int").alias("height"))
    nodes, path = materialise(nodes.withColumn("leaves", (F.col("children") == 0).cast("long")), "nodes")
    paths.append(path)

    # each node's ancestors at the distances that it is grafted to: 2^j for j up to its height
    steps = nodes.where("d > 1").select("name", "height", F.col("rep").alias("conv"), "d", F.explode(F.sequence(F.lit(0), "height")).alias("j"))
    steps = steps.withColumn("d", F.col("d") - F.expr("shiftleft(1L, j)"))
    up = steps.join(turns.select("conv", "d", F.col("name").alias("up")), ["conv", "d"])
    x = F.col("d") - 1
    links, path = materialise(up.select("name", "height", "j", "up", F.when(x == 0, F.lit(levels)).otherwise(F.bit_count(x.bitwiseAND(-x) - 1)).cast("int").alias("up_height")), "links")
    paths.append(path)

    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]

    def plus(rows: DataFrame, more: DataFrame) -> DataFrame:
        """(name, leaves, saved) of rows with those of ``more`` (up, add_leaves, add_saved) added."""
        both = rows.join(more.select(F.col("up").alias("name"), F.col("leaves").alias("add_leaves"), F.col("saved").alias("add_saved")), "name", "left")
        return both.select("name", (F.col("leaves") + F.coalesce("add_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("add_saved", F.lit(0))).alias("saved"))

    def inside(j: int) -> DataFrame:
        """Roots of pieces of height j and no higher, with the totals of their piece."""
        own = nodes.where(F.col("height") == j).select("name", "leaves", "saved")
        return plus(own, gathered[j].where(F.col("up_height") == j)) if j else own

    gathered: list[DataFrame | None] = [None]
    for j in range(levels):
        sent = links.where((F.col("height") == j) & (F.col("j") == j)).join(inside(j), "name").select("up", "up_height", "leaves", "saved")
        held = sent if not j else sent.union(gathered[j].where(F.col("up_height") > j).select("up", "up_height", "leaves", "saved"))
        more, path = materialise(held.groupBy("up", "up_height").agg(*sums), "grafts")
        gathered.append(more)
        paths.append(path)
    whole = inside(levels)
    totals = [whole]
    for j in range(levels - 1, -1, -1):
        done = totals[0]
        for t in totals[1:]:
            done = done.union(t)
        below = links.where((F.col("j") == j) & (F.col("height") > j)).join(done, "name").groupBy("up").agg(*sums)
        total, path = materialise(plus(inside(j), below), "totals")
        totals.append(total)
        paths.append(path)
    whole, path = materialise(totals[0], "totals")
    paths.append(path)
    done = whole
    for t in totals[1:]:
        done = done.union(t)

    ends = _ends(turns.where(F.col("d") == F.col("len")).select("name", "conv").union(convs.where("len = 0").select(F.lit(ROOT), "conv")))
    parents = nodes.select(F.col("name").alias("parent"), F.col("rep").alias("parent_rep")).union(convs.agg(F.lit(ROOT).alias("parent"), F.min("conv").alias("parent_rep")))
    rows = nodes.drop("leaves", "saved").join(done, "name").join(parents, "parent").select("name", F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.col("parent_rep").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    top = nodes.where("d = 1").select("name").join(whole, "name").agg(F.count("*"), F.sum("leaves"), F.sum("saved")).first()
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    root = root.select(F.lit(ROOT).alias("name"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", *(F.lit(v).cast("long").alias(c) for v, c in ((top[0], "n_children"), (top[1] or 1, "n_leaves"), (top[2] or 0, "saved_tokens"))))
    trie = rows.union(root).join(ends, "name", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))).drop("name")
    trie, _ = materialise(trie, "trie")
    discard(placed.sparkSession, *paths)
    return trie


def trie_of(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text", base: Column | None = None, keep: Column | None = None) -> DataFrame:
    """``prefix_trie`` of a table of turns, as ``numbered`` reads it; with base and keep, of the conversations that ``rebranched`` makes.

    In base and keep, the column conv is the conversation's id. Nulls in any column, ties and repeated rows (each is a turn) are
    taken as ``numbered`` says; texts of any length count whole, an empty table gives no rows, other columns are ignored.
    """
    placed, convs, paths = numbered(turns, id_col, order_col, role_col, text_col)
    if base is not None and keep is not None:
        placed, convs, more = rebranched(placed, convs, base, keep)
        paths += more
    trie = prefix_trie(placed, convs)
    discard(turns.sparkSession, *paths)
    return trie
