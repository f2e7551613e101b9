import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import queries, turntrie


def brute(rows, branch=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    made = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 9 if branch else 0
        made[c] = tuple(convs.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    out = []
    totals = defaultdict(lambda: [0, 0])
    for p, cs in members.items():
        for d in range(len(p) + 1):
            totals[p[:d]][0] += not children[p]
            totals[p[:d]][1] += (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(made[c]) == len(p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else -(10**9), len(cs), children[p], *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((r[0], r[1], -(10**9) if r[2] is None else r[2], *r[3:]) for r in df.collect())


def tried(df, branch=True):
    conv = F.col("conv")
    return turntrie.trie_of(df, base=conv - conv % 5, keep=F.crc32(conv.cast("string")) % 9) if branch else turntrie.trie_of(df)


@pytest.mark.parametrize("seed,branch", [(1, True), (2, False)])
def test_matches_brute_force(spark, seed, branch):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(-12, 40), 1000, 2003]:
        for k in range(rnd.choice([1, 2, 3, 8, 9, 12, 37])):
            rows.append((c, rnd.choice([k, k, k, None]), rnd.choice(["user", "user", None]), rnd.choice(["a", "a", "a", "", None, "é" * 3])))
    rows += [(50 + k, t, "user", f"same {t}") for k in range(30) for t in range(11)]  # a hot group of equal conversations
    rows += [(None, 1, "user", "no id"), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, name string, conv int").repartition(5)
    assert found(tried(df, branch)) == brute(rows, branch)


def test_one_long_conversation_fills_many_tasks(spark):
    rows = [(5, k, "user", str(k % 3)) for k in range(700)] + [(6, k, "user", str(k % 3) if k < 650 else "x") for k in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    placed, _, _ = turntrie.numbered(df)
    assert sorted((r.conv, r.pos) for r in placed.collect()) == [(c, k) for c in (5, 6) for k in range(1, 701)]
    assert found(tried(df, False)) == brute(rows, False)


def test_turnless_conversations_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    turnless = [(c, 0, "u", "t") for c in (1, 2, 3, 4, 6) if zlib.crc32(str(c).encode()) % 9]
    assert found(tried(spark.createDataFrame(turnless, schema))) == brute(turnless) and brute(turnless)[0][4] == 0
    assert tried(spark.createDataFrame([], schema)).count() == 0


def test_whole_table_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = queries.op13_prefix_trie(spark, sf)
    want = con.execute(queries.ORACLE["op13_prefix_trie"]).fetchall()
    assert all(t in ("bigint", "string") for _, t in got.dtypes)
    assert found(got) == sorted((r[0], r[1], -(10**9) if r[2] is None else r[2], *r[3:]) for r in want)
    assert found(got) == brute(spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect())
