"""Assignments of many matrices and rounds with bounds against solving everything."""

import numpy as np

from touchline.operators import assignments, rounds
from touchline.operators import formations as fm


def test_assignments_equal_the_search_over_sets():
    rng = np.random.default_rng(5)
    for n in (1, 2, 4, 7):
        a, b = rng.normal(size=(2, 200, n, 2)) * 30
        grid = rng.integers(0, 3, (2, 200, n, 2))
        gaps = rng.random((200, n, n))
        gaps[rng.random(gaps.shape) < 0.05] = np.nan
        far = rng.random((200, n, n))
        far[0] = np.inf
        for costs in (((a[:, :, None] - b[:, None]) ** 2).sum(-1), ((grid[0][:, :, None] - grid[1][:, None]) ** 2).sum(-1).astype(float), np.zeros((200, n, n)), gaps, far):
            for got, want in zip(assignments.best_assignments(costs), assignments.assignments_by_sets(costs)):
                assert np.array_equal(got, want, equal_nan=True)


def test_rounds_with_bounds_equal_whole_ones_and_solve_fewer(monkeypatch):
    rng = np.random.default_rng(2)
    bases = rng.normal(size=(6, 10, 2)) * 30
    pts = bases[rng.integers(0, 6, 150)] + rng.normal(size=(150, 10, 2)) * 3
    table = rounds.slots(3, 5)
    places = [np.array([i for i, (of, _) in enumerate(table) if of == k]) for k in (3, 4, 5)]
    held, many = np.ones(len(table), bool), np.zeros(150, bool)
    shapes, label, lower, moved, solved = np.concatenate([pts[10 : 10 + k] for k in (3, 4, 5)]), None, None, None, []
    inner = rounds.best_assignments
    monkeypatch.setattr(rounds, "best_assignments", lambda c: solved.append(len(c)) or inner(c))
    for turn in range(6):
        whole = rounds._one_slice(pts, many, shapes, held, None, None, None, places, True)
        solved.clear()
        got = rounds._one_slice(pts, many, shapes, held, moved, label, lower, places, False)
        for a, b in zip((*got[:3], *got[5:]), (*whole[:3], *whole[5:])):
            assert np.array_equal(a, b, equal_nan=True)
        assert not turn or sum(solved) < 0.6 * len(pts) * len(table)
        label, lower, before = got[0], got[4], shapes
        held = got[6].any(axis=(1, 2))
        shapes = got[5] / np.where(got[6] > 0, got[6], np.nan)
        moved = np.sqrt(((shapes - before) ** 2).sum(axis=(1, 2))) + rounds.ROOM


def test_prices_lead_to_the_same_assignments():
    rng = np.random.default_rng(7)
    for n in (1, 4, 10):
        a, b = rng.normal(size=(2, 60, n, 2)) * 30
        costs = ((a[:, :, None] - b[:, None]) ** 2).sum(-1)
        costs[:10] = np.round(costs[:10] / 400)
        costs[3, 0, 0] = np.nan
        want = assignments.assignments_by_sets(costs)
        for prices in (np.full((60, n), np.nan), rng.normal(size=(60, n)) * 500):
            *got, own = assignments.priced_assignments(costs, prices)
            for g, w in zip(got, want):
                assert np.array_equal(g, w, equal_nan=True)
            known = np.isfinite(own).all(axis=1)
            priced = costs - own[:, None, :]
            chosen = np.take_along_axis(priced, got[1][:, :, None], axis=2)
            assert known[10:].all() and (priced[known] >= chosen[known] - 1e-9).all()


def test_a_whole_group_runs_the_rounds_that_slices_run(spark, monkeypatch):
    """Groups in one task give the rows of groups in slices, with repeated keys, missing points and groups of few blocks."""
    rng = np.random.default_rng(4)
    rows = [(g, f"b{i}", [(float(x), float(y)) for x, y in rng.normal(size=(10, 2)) * 20]) for g, n in (("a", 90), (None, 40), ("few", 2), ("one", 1)) for i in range(n)]
    rows[5] = (rows[5][0], None, rows[5][2])
    rows[6] = (*rows[6][:2], [(None, 1.0), *rows[6][2][1:]])
    rows += [rows[7], rows[8], ("a", "none", None)]
    df = spark.createDataFrame(rows, "g string, b string, pts array<struct<x:double,y:double>>")
    asked, plain = [], rounds.next_round
    monkeypatch.setattr(rounds, "next_round", lambda *a, **k: asked.append(1) or plain(*a, **k))

    def run(whole):
        monkeypatch.setattr(rounds, "WHOLE", whole)
        asked.clear()
        out = fm.cluster_blocks(df, ["g"], ["b"], k_min=3, k_max=4).collect()
        near = lambda v: None if v is None else round(v, 7)
        return sorted(((r.g or "", r.b or "", r.cluster_label, r.n_blocks_in_cluster, r.is_medoid, near(r.member_cost), near(r.silhouette)) for r in out), key=str), len(asked)

    whole, few = run(1000)
    assert few == 1  # the last pass alone is over slices
    mixed, more = run(60)
    assert mixed == whole and more > 3
