"""Cheapest one-to-one assignments of many small matrices at once."""

from __future__ import annotations

import numpy as np

# Search states per matrix size, filled once per Python worker.
STATES: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
STATES_BATCH = 64
# Under this number of matrices the search over sets is the faster one.
FEW = 128
# Fixed value: assignments whose totals differ by less than this share of the largest cost are told apart by the search over sets.
SAME = 1e-9


def _states(n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per matched row: the sets of used columns, each set's columns, and the sets they came from."""
    if n not in STATES:
        by_size: list[list[int]] = [[] for _ in range(n + 1)]
        for used in range(1 << n):
            by_size[used.bit_count()].append(used)
        steps = []
        for size in range(1, n + 1):
            sets = np.array(by_size[size])
            columns = np.array([[c for c in range(n) if used >> c & 1] for used in by_size[size]])
            steps.append((sets, columns, sets[:, None] ^ (1 << columns)))
        STATES[n] = steps
    return STATES[n]


def assignments_by_sets(costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest assignments by the sets of used columns.

    Row i is matched after rows 0..i-1, so the state is the set of used columns; all matrices of the batch move
    through the 2^n states together, one row at a time. Returns total costs and the column of every row.
    """
    batch, n, _ = costs.shape
    by_cell = np.ascontiguousarray(costs.transpose(1, 2, 0))
    best = np.empty((1 << n, batch))
    choice = np.zeros((1 << n, batch), dtype=np.int8)
    best[0] = 0.0
    for row, (sets, columns, before) in enumerate(_states(n)):
        totals = best[before] + by_cell[row][columns]
        pick = totals.argmin(axis=1)
        best[sets] = np.take_along_axis(totals, pick[:, None, :], axis=1)[:, 0, :]
        choice[sets] = np.take_along_axis(columns, pick, axis=1)
    chosen = np.zeros((batch, n), dtype=np.int32)
    state = np.full(batch, (1 << n) - 1)
    each = np.arange(batch)
    for row in range(n - 1, -1, -1):
        chosen[:, row] = choice[state, each]
        state = state ^ (1 << chosen[:, row].astype(np.int64))
    return best[-1], chosen


def _add_row(i: int, costs: np.ndarray, u: np.ndarray, v: np.ndarray, column_of: np.ndarray, row_of: np.ndarray) -> None:
    """Match row ``i`` of all matrices by a shortest path to a free column; prices and matches change in place."""
    m, n, _ = costs.shape
    dist, way, done = np.full((m, n), np.inf), np.full((m, n), -1), np.zeros((m, n), bool)
    row, came, reached, end = np.full(m, i), np.full(m, -1), np.zeros(m), np.full(m, -1)
    active = np.arange(m)
    while active.size:
        r, closed = row[active], done[active]
        new = costs[active, r] - u[active, r][:, None] - v[active] + reached[active][:, None]
        shorter = (new < dist[active]) & ~closed
        near = np.where(shorter, new, dist[active])
        dist[active] = near
        way[active] = np.where(shorter, came[active][:, None], way[active])
        near = np.where(closed, np.inf, near)
        j = near.argmin(axis=1)
        reached[active], came[active] = near[np.arange(len(j)), j], j
        following = row_of[active, j]
        free = following < 0
        end[active[free]] = j[free]
        active, j = active[~free], j[~free]
        done[active, j] = True
        row[active] = following[~free]
    slack = np.where(done, reached[:, None] - dist, 0.0)
    v -= slack
    at, column = np.nonzero(done)
    u[at, row_of[at, column]] += slack[at, column]
    u[:, i] += reached
    active = np.arange(m)
    while active.size:
        j = end[active]
        before = way[active, j]
        moved = np.where(before < 0, i, row_of[active, before])
        row_of[active, j] = moved
        column_of[active, moved] = j
        end[active] = before
        active = active[before >= 0]


def _only_one(tight: np.ndarray, column_of: np.ndarray) -> np.ndarray:
    """Whether no other assignment uses tight cells alone: exchanges along them form no ring."""
    m, n, _ = tight.shape
    each, rows = np.arange(m)[:, None], np.arange(n)[None]
    tight[each, rows, column_of] = False
    exchange = tight[each[..., None], rows[..., None], column_of[:, None, :]]  # row to the row whose column it could take
    left = np.ones((m, n), bool)
    for _ in range(n):
        fewer = left & (exchange & left[:, None, :]).any(axis=2)
        if (fewer == left).all():
            break
        left = fewer
    return ~left.any(axis=1)


def _by_paths(costs: np.ndarray, prices: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cheapest assignments by shortest paths, started from ``prices`` of the columns, and whether paths alone settled them."""
    batch, n, _ = costs.shape
    column_of, alone = np.full((batch, n), -1), np.zeros(batch, bool)
    sure = np.isfinite(costs).all(axis=(1, 2))
    at = np.flatnonzero(sure)
    if at.size:
        known = costs[at]
        v = known.min(axis=1)
        if prices is not None:
            v = np.where(np.isfinite(prices[at]).all(axis=1)[:, None], prices[at], v)
        reduced = known - v[:, None, :]
        u, first = reduced.min(axis=2), reduced.argmin(axis=2)
        columns, rows, each = np.full((len(at), n), -1), np.full((len(at), n), -1), np.arange(len(at))
        for i in range(n):
            free = rows[each, first[:, i]] < 0
            rows[each[free], first[free, i]] = i
            columns[free, i] = first[free, i]
        for i in range(n):
            todo = np.flatnonzero(columns[:, i] < 0)
            if todo.size:
                part = [a[todo] for a in (u, v, columns, rows)]
                _add_row(i, known[todo], *part)
                u[todo], v[todo], columns[todo], rows[todo] = part
        room = SAME * np.maximum(np.abs(known).max(axis=(1, 2)), 1e-300)
        tight = known - u[:, :, None] - v[:, None, :] <= room[:, None, None]
        column_of[at] = columns
        sure[at] = alone[at] = _only_one(tight, columns)
    total, each = np.zeros(batch), np.arange(batch)
    for i in range(n):
        total = total + costs[each, i, column_of[:, i]]
    rest = np.flatnonzero(~sure)
    for part in np.array_split(rest, -(-len(rest) // STATES_BATCH)) if rest.size else []:
        total[part], column_of[part] = assignments_by_sets(costs[part])
    return total, column_of.astype(np.int32), alone


def priced_assignments(costs: np.ndarray, prices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cheapest assignments as ``best_assignments`` gives them, started from ``prices`` of the columns, and their own prices.

    Any prices lead to the same answer; those of a matrix that differs little leave few rows to match. The prices given back
    lie in the middle of all that show the assignment to be the cheapest, so they do for matrices near by too; NaN: none.
    """
    total, column_of, alone = _by_paths(costs, prices)
    found, at = np.full(column_of.shape, np.nan), np.flatnonzero(alone)
    if at.size:
        n, each = column_of.shape[1], np.arange(len(at))
        row_of = np.argsort(column_of[at], axis=1)
        by_column = np.ascontiguousarray(costs[at][each[:, None], row_of].transpose(1, 2, 0))
        # what moving from a matched column to another one costs, and then any way between the two
        way = by_column - by_column[np.arange(n), np.arange(n)][:, None]
        for k in range(n):
            way = np.minimum(way, way[:, k : k + 1] + way[k : k + 1])
        found[at] = ((way.mean(axis=0) - way.mean(axis=1)) / 2).T
    return total, column_of, found


def best_assignments(costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest one-to-one assignment of each (n, n) matrix in a (batch, n, n) array: total costs and the column of every row.

    Rows are matched one by one along shortest paths, all matrices together. Where an assignment costs as much as
    another, or a cost is missing, the search over sets of columns decides, so equal matrices have equal answers.
    """
    if len(costs) < FEW:
        return assignments_by_sets(costs)
    return _by_paths(costs)[:2]
