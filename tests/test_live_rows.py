"""Streams' state on rows: no frame for each key and batch, and the rows of the exact twins."""

import random

import pytest
from pyspark.sql import Row
from test_live import DAY, Single, State, brute, event

from tapeloom.streaming import live

NAMES = ("seq", "type", "step", "message", "progress", "transcript", "transcript_path", "error")


@pytest.mark.parametrize("seed", range(3))
def test_jobs_are_folded_without_frames(seed, monkeypatch):
    monkeypatch.setattr(live, "pd", None)
    rnd, f, seen = random.Random(seed), live._RowFold(), []
    f.pages, f.stop = State(), Single()
    events = [event(rnd, s) for s in rnd.sample(range(900), 150)]
    for at in range(0, len(events), 25):
        part = events[at : at + 25]
        seen += part
        (row,) = f.handleInputRows(("j",), iter([Row(**dict(zip(NAMES, e))) for e in part]), None)
        assert row.job_id == "j" and {k: v for k, v in row.asDict().items() if k != "job_id"} == brute(seen)


def test_streaks_are_counted_without_frames(monkeypatch):
    monkeypatch.setattr(live, "pd", None)
    rnd, p, seen = random.Random(1), live._RowStreaks(400 * DAY), set()
    p.at_pages, p.length_pages, p.count = State(), State(), Single()
    for _ in range(30):
        batch = [rnd.randrange(-5, 420) * DAY for _ in range(9)]
        seen |= {t for t in batch if 3 * DAY < t <= 400 * DAY}
        (row,) = p.handleInputRows(("u",), iter([Row(ts_ms=t, started_ms=3 * DAY) for t in [*batch, None]]), None)
        marks = [3 * DAY, *sorted(seen), 400 * DAY]
        assert tuple(row) == ("u", len(seen), 400 * DAY - marks[-2], max(b - a for a, b in zip(marks, marks[1:])), 397 * DAY)


class Texts(State):
    def iterator(self):
        self.asked += 1
        return iter(list(self.held.items()))


def test_texts_are_read_at_once_and_without_frames(monkeypatch):
    monkeypatch.setattr(live, "pd", None)
    rnd, p, seen = random.Random(2), live._Texts(), {}
    p.texts = Texts()
    for _ in range(40):
        batch = [(rnd.randrange(6), rnd.choice(["a", "b", "", None]), rnd.choice(["1", "2", None])) for _ in range(4)]
        for k, text, at in batch:
            seen[k] = max(seen.get(k, ("", "")), (at or "", text or ""))
        before = p.texts.asked
        (row,) = p.handleInputRows(("j",), iter([Row(chunk_idx=k, text=text, at=at) for k, text, at in batch]), None)
        assert [(r.chunk_idx, r.text) for r in row.texts] == [(k, v[1]) for k, v in sorted(seen.items())]
        assert p.texts.asked - before <= 1 + len({k for k, *_ in batch})
