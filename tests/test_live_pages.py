"""State in pages: the rows of the exact twins, in few calls of the state."""

import random

import pandas as pd
import pytest
from test_live import DAY, Single, State, brute, event, feed

from tapeloom.streaming import history, live


def fold(late=None):
    f = live._PagedFold(late)
    f.pages, f.stop = State(), Single()
    return f


@pytest.mark.parametrize("seed", range(6))
def test_rows_are_exact_in_any_order(seed, monkeypatch):
    monkeypatch.setattr(live, "PagedHistory", lambda fields, pages: history.PagedHistory(fields, pages, page=5 if seed % 2 else 64))
    rnd = random.Random(seed)
    numbers = rnd.sample(range(-500, 4000), 150) + [history.LOWEST, history.HIGHEST, 2**40]
    events = [event(rnd, s, errors=0.02 if seed < 4 else 0) for s in numbers]
    f, seen = fold(), []
    while len(seen) < len(events):
        part = events[len(seen) : len(seen) + rnd.randrange(1, 12)]
        seen += part
        assert {k: None if v != v else v for k, v in feed(f, part).items() if k != "job_id"} == brute(seen)


def test_first_and_last_find_what_a_sorted_list_has():
    for page in (3, 40):
        rnd, state, held = random.Random(6), State(), set()
        h = history.PagedHistory(("x", "y"), state, page)
        for _ in range(1500):
            n = rnd.choice([rnd.randrange(300), rnd.randrange(-(2**63), 2**63), history.HIGHEST, history.LOWEST])
            if n in held and rnd.random() < 0.5:
                h.drop("x", n)
                held.discard(n)
            else:
                h.add(n, {"x": 1})
                held.add(n)
            h.add(rnd.randrange(300), {"y": 2})
            if rnd.random() < 0.02:
                cut = rnd.randrange(300)
                h.drop_after(cut)
                held = {v for v in held if v <= cut}
            if rnd.random() < 0.1:
                h.flush()
                h = history.PagedHistory(("x", "y"), state, page)
            q = rnd.choice([n, rnd.randrange(300)])
            assert h.first("x", q) == min((v for v in held if v > q), default=None)
            assert h.last("x", q) == max((v for v in held if v <= q), default=None)


def test_a_batch_takes_far_fewer_calls_than_it_has_events():
    rnd, f, asked = random.Random(3), fold(), []
    for k in range(40):
        before = f.pages.asked
        feed(f, [event(rnd, 1000 * k + 7 * i, errors=0) for i in range(140)])
        asked.append(f.pages.asked - before)
    assert max(asked) < 60
    assert sum(asked) / len(asked) < 25  # one entry a number took over 280 a batch
    late = (700, "error", None, None, None, None, None, "late")
    assert feed(f, [late])["last_seq"] == 700
    assert len(f.pages.held) < 20


def test_streaks_in_pages_equal_those_by_number():
    rnd, now, started = random.Random(5), 400 * DAY, 10 * DAY
    one, other = live._Streaks(now), live._PagedStreaks(now)
    one.at_nodes, one.at_rows, one.length_nodes, one.length_rows = (State() for _ in range(4))
    other.at_pages, other.length_pages = State(), State()
    one.count, other.count = Single(), Single()
    for _ in range(30):
        pdf = pd.DataFrame({"ts_ms": [rnd.randrange(0, 420) * DAY + rnd.choice([0, 0, 1, DAY // 2]) for _ in range(50)], "started_ms": started})
        a, b = (list(p.handleInputRows(("u",), iter([pdf]), None))[0] for p in (one, other))
        assert a.equals(b)
    assert other.at_pages.asked + other.length_pages.asked < 30 * 30
