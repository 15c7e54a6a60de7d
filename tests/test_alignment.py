"""Ordered alignment of events and frames against an exhaustive search."""

import random
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest

from touchline.operators import alignment

START = datetime(2024, 1, 1)


def plain_cost(event_t, frame_t, tol, gap, distance=None):
    """Least total cost over every order-preserving choice of frames."""
    best = np.inf
    n = len(event_t)
    for size in range(min(n, len(frame_t)) + 1):
        for es in combinations(range(n), size):
            for fs in combinations(range(len(frame_t)), size):
                if all(abs(event_t[e] - frame_t[f]) <= tol for e, f in zip(es, fs)):
                    cost = sum(abs(event_t[e] - frame_t[f]) / tol + (distance[e][f] if distance is not None else 0) for e, f in zip(es, fs))
                    best = min(best, cost + gap * (n - size))
    return best


def test_least_cost_equals_exhaustive_search():
    rnd = random.Random(1)
    for _ in range(300):
        e = np.array(sorted(rnd.randint(0, 30) for _ in range(rnd.randint(0, 5))), float)
        f = np.array(sorted(rnd.randint(-3, 33) for _ in range(rnd.randint(0, 6))), float)
        tol, gap = rnd.choice([2, 5, 12]), rnd.choice([0.3, 1.0, 2.0])
        extra = np.array([[rnd.random() for _ in f] for _ in e]).reshape(len(e), len(f))
        first, last = np.searchsorted(f, e - tol, "left"), np.searchsorted(f, e + tol, "right")
        costs = [np.abs(f[a:b] - e[i]) / tol + extra[i, a:b] for i, (a, b) in enumerate(zip(first, last))]
        chosen, total = alignment.align(costs, first, gap)
        used = chosen[chosen >= 0]
        assert (np.diff(used) > 0).all()
        said = sum(gap if k < 0 else costs[i][k - first[i]] for i, k in enumerate(chosen))
        assert said == pytest.approx(total) == pytest.approx(plain_cost(e, f, tol, gap, extra))


def test_batches_give_the_total_of_one_alignment(spark, small_chunks, monkeypatch):
    """Batches cut at quiet stretches, with tiny chunks, equal one alignment of the whole match; odd rows keep their place."""
    rnd = random.Random(5)
    monkeypatch.setattr(alignment, "CHUNK_MICROS", 3_000_000)
    events, frames, at = [], [], 0.0
    for i in range(120):
        at += rnd.choice([0.0, 0.1, 0.3, 1.2, 4.0])
        events.append(("m1", i, START + timedelta(seconds=at), rnd.uniform(0, 100), None if i % 7 == 0 else rnd.uniform(0, 60)))
    for k in range(int(at / 0.4) + 3):
        if rnd.random() < 0.6:
            frames.append(("m1", k, START + timedelta(seconds=0.4 * k), rnd.uniform(0, 100), rnd.uniform(0, 60)))
    more = [("m2", 500, START, 1.0, 1.0), ("m1", 501, None, 1.0, 1.0), (None, 502, START, 1.0, 1.0)]
    ev = spark.createDataFrame(events + more, "m string, event_id int, ts timestamp, x double, y double")
    fr = spark.createDataFrame(frames + [(None, 9, START + timedelta(seconds=0.2), 1.0, 1.0), ("m2", None, None, 1.0, 1.0)], "m string, frame int, ts timestamp, bx double, by double")
    for places in (None, ("x", "y", "bx", "by")):
        got = {r.event_id: (r.frame, r.offset_us) for r in alignment.align_events(fr, ev, ["m"], places=places).collect()}
        assert len(got) == 123 and got[500] == got[501] == (None, None) and got[502] == (9, 200_000)
        e = np.array([(t - START).total_seconds() for _, _, t, *_ in events])
        f = np.array([(t - START).total_seconds() for _, _, t, *_ in frames])
        first, last = np.searchsorted(f, e - 1.0 - 1e-9), np.searchsorted(f, e + 1.0 + 1e-9)
        far = lambda i, k: np.hypot(frames[k][3] - events[i][3], frames[k][4] - events[i][4]) / 25.0 if places and events[i][4] is not None else 0.0
        costs = [np.array([abs(f[k] - e[i]) + far(i, k) for k in range(a, b)]) for i, (a, b) in enumerate(zip(first, last))]
        _, total = alignment.align(costs, first, 1.0)
        place = {r[1]: k for k, r in enumerate(frames)}
        said, used = 0.0, []
        for i in range(120):
            k = got[i][0]
            said += 1.0 if k is None else costs[i][place[k] - first[i]]
            used += [] if k is None else [k]
        assert said == pytest.approx(total) and len(set(used)) == len(used)
        times = sorted((e[i], f[place[got[i][0]]]) for i in range(120) if got[i][0] is not None)
        assert [b for _, b in times] == sorted(b for _, b in times)
