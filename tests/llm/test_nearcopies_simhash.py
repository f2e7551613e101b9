"""Near copies meet by SimHash fingerprints first."""

from itertools import combinations

from tapeloom.llm import nearcopies, simhash


def test_candidates_are_what_fingerprints_link(spark):
    base = 0x0123456789ABCDEF
    prints = {1: base, 2: base, 3: base ^ 3, 4: base ^ 7 << 20, 5: base ^ 3 ^ 1 << 40, 6: ~base & (1 << 62) - 1}
    rows = spark.createDataFrame(list(prints.items()), "node long, fp long")
    root = {k: k for k in prints}
    got = [(r.a, r.b) for r in nearcopies._by_fingerprint(rows, 2, 1024).collect()]
    for _ in prints:
        for a, b in [*got, *((b, a) for a, b in got)]:
            root[a] = min(root[a], root[b])
    want = {k: k for k in prints}
    for _ in prints:
        for a, b in combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                want[a] = want[b] = min(want[a], want[b])
    assert root == want == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 6}


def test_groups_ask_simhash(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(nearcopies, "near_links", lambda *a: asked.append(a) or simhash.near_links(*a))
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, "other words here")]
    out = nearcopies.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()} == {1: 1, 2: 1, 3: 3} and asked
