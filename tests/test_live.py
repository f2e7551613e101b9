"""Streaming state that is looked up by range: exact rows for any order, and work that does not grow with the history."""

import random

import pandas as pd
import pytest

from tapeloom.operators import chunks, streaks
from tapeloom.streaming import history, live

DAY = 86_400_000


class State:
    """Keyed state as a dictionary that counts what is asked of it."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def getValue(self, key):
        self.asked += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.asked += 1
        self.held[key] = value

    def removeKey(self, key):
        self.asked += 1
        self.held.pop(key, None)


class Single:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def fold(late=None):
    f = live._Fold(late)
    f.nodes, f.rows, f.stop = State(), State(), Single()
    return f


def feed(f, events):
    names = ["seq", "type", "step", "message", "progress", "transcript", "transcript_path", "error"]
    (row,) = f.handleInputRows(("j",), iter([pd.DataFrame(events, columns=names)]), None)
    return row.to_dict("records")[0]


def event(rnd, seq, errors=0.02):
    kind = "error" if rnd.random() < errors else rnd.choice(["status", "status", "done"])
    pick = lambda *xs: rnd.choice(xs)
    return (seq, kind, pick("a", "", None), pick(f"m{seq}", "", None), pick(float(seq % 130), None), pick(f"t{seq}", "", None), pick(f"p{seq}", None), "bad" if kind == "error" else None)


def brute(events):
    stop = min((e[0] for e in events if e[1] == "error"), default=None)
    out = {"done": False, "error": None, "message": None, "progress": None, "step": None, "transcript": None, "transcript_path": None}
    for seq, kind, step, message, progress, transcript, path, error in sorted(e for e in events if stop is None or e[0] <= stop):
        out["last_seq"] = seq
        out["message"] = message or out["message"]
        if progress is not None:
            out["step"] = step or "处理中"
        if progress is not None or kind == "done":
            out["progress"] = 100.0 if kind == "done" else min(100.0, progress)
        out["transcript"] = transcript if transcript is not None else out["transcript"]
        out["transcript_path"] = path or out["transcript_path"]
        out["done"] |= kind == "done"
        out["error"] = error or out["error"]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_rows_are_exact_in_any_order(seed):
    rnd = random.Random(seed)
    numbers = rnd.sample(range(-500, 4000), 150) + [history.LOWEST, history.HIGHEST, 2**40]
    events = [event(rnd, s) for s in numbers]
    f, seen = fold(), []
    while len(seen) < len(events):
        part = events[len(seen) : len(seen) + rnd.randrange(1, 12)]
        seen += part
        got = feed(f, part)
        assert {k: None if v != v else v for k, v in got.items() if k != "job_id"} == brute(seen)


def test_work_and_bounded_state_over_a_thousand_batches():
    rnd = random.Random(1)
    for late in (None, 50):
        f, work, size, events = fold(late), [], [], []
        for n in range(1000):
            before = f.nodes.asked + f.rows.asked
            batch = [event(rnd, 2 * n + rnd.choice([0, 1]) if n % 3 else max(0, 2 * n - rnd.randrange(20)), errors=0)]
            events = [e for e in events if e[0] != batch[0][0]] + batch
            row = feed(f, batch)
            work.append(f.nodes.asked + f.rows.asked - before)
            size.append(len(f.rows.held))
        assert row["last_seq"] == max(e[0] for e in events)
        assert max(work[-200:]) <= max(work[:200]) + 4
        if late:
            assert max(size) <= 60
    assert feed(f, [event(rnd, 1990, errors=1)])["error"] == "bad"  # within late: it cuts what came before it in time


def test_a_late_error_cuts_and_each_value_goes_once():
    f = fold()
    rnd = random.Random(2)
    events = [event(rnd, s, errors=0) for s in range(2000) if s != 700]
    for k in range(0, 2000, 50):
        feed(f, events[k : k + 50])
    bad = (700, "error", None, None, None, None, None, "late")
    got = feed(f, [bad])
    want = brute([*events, bad])
    assert (got["error"], got["last_seq"]) == ("late", 700) and got["message"] == want["message"]
    assert len(f.rows.held) == 701
    before = f.nodes.asked + f.rows.asked
    feed(f, [event(rnd, 5000, errors=0)])  # after the end: nothing is kept of it
    assert f.nodes.asked + f.rows.asked - before < 150 and len(f.rows.held) == 701


def test_streaks_by_range_equal_the_batch_and_read_what_they_touch(spark):
    rnd = random.Random(5)
    now, started = 400 * DAY, 10 * DAY
    instants = [rnd.randrange(0, 420) * DAY + rnd.choice([0, 0, 1, DAY // 2]) for _ in range(600)] + [started, now, now + 1]
    f = live._Streaks(now)
    states = [State() for _ in range(4)]
    f.at_nodes, f.at_rows, f.length_nodes, f.length_rows = states
    f.count = Single()
    work, got = [], None
    for n in range(0, len(instants), 3):
        before = sum(x.asked for x in states)
        pdf = pd.DataFrame({"ts_ms": instants[n : n + 3], "started_ms": started})
        (row,) = f.handleInputRows(("u",), iter([pdf]), None)
        got = row.to_dict("records")[0]
        work.append(sum(x.asked for x in states) - before)
        kept = sorted({t for t in instants[: n + 3] if started < t <= now})
        ends = [started, *kept, now]
        gaps = [b - a for a, b in zip(ends, ends[1:])]
        assert (got["relapse_count"], got["current_ms"], got["best_ms"], got["total_ms"]) == (len(kept), gaps[-1], max(gaps), now - started)
    assert max(work[-50:]) <= max(work[:50]) + 20
    users = spark.createDataFrame([("u", started)], "user_id string, started_ms long")
    batch = streaks.build_streaks(spark.createDataFrame([("u", t) for t in instants], "user_id string, ts_ms long"), users, now)
    raw = spark.createDataFrame([("u", got["relapse_count"], got["current_ms"] / DAY, got["best_ms"] / DAY, got["total_ms"] / DAY / (got["relapse_count"] + 1))], "user_id string, relapse_count long, current_days double, best_days double, avg_days double")
    assert streaks.labelled(raw).first() == streaks.streak_stats(batch).first()


def test_first_and_last_find_what_a_sorted_list_has():
    rnd = random.Random(6)
    h = history.History(("x",), State(), State())
    held = set()
    for _ in range(600):
        n = rnd.choice([rnd.randrange(300), rnd.randrange(-(2**63), 2**63), history.HIGHEST])
        if n in held and rnd.random() < 0.5:
            h.drop("x", n)
            held.discard(n)
        else:
            h.add(n, {"x": 1})
            held.add(n)
        q = rnd.choice([n, rnd.randrange(300)])
        assert h.first("x", q) == min((v for v in held if v > q), default=None)
        assert h.last("x", q) == max((v for v in held if v <= q), default=None)


def test_words_of_chunks_count_like_the_windows(spark):
    sets = {1: range(70), 2: [0, 1, 3, 200], 3: range(63), 4: range(64), 5: [63], 6: [], 7: [64, 65], 8: range(128), 9: [5], 10: [*range(64), *range(65, 130)]}
    results = [(j, k, "x") for j, ks in sets.items() for k in ks] + [(2, 2, " "), (99, 0, "other")]
    totals = [(1, 70), (2, 4), (3, 64), (4, 64), (5, 64), (6, 3), (7, 66), (8, 127), (9, None), (10, 130), (11, 63)] + [(12, 0)]
    t = spark.createDataFrame(totals, "job_id long, total_chunks int")
    r = spark.createDataFrame(results + results[:40], "job_id long, chunk_idx int, text string").repartition(3)
    assert sorted(chunks.word_progress(t, chunks.chunk_words(r)).collect()) == sorted(chunks.chunk_progress(t, r).collect())
    plan = chunks.chunk_words(r)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
