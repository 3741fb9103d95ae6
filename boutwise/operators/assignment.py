"""Assignment of rows to columns with the largest total, one square matrix at a time.

Rows enter one by one. Potentials keep every reduced cost at or above 0 and the chosen cells at 0; a new row grows a tree of shortest paths over all
columns at once until it meets a free one, and the choice flips along that path. The best assignments are then the perfect matchings of the cells with
reduced cost 0, from which the lexicographically first is taken, a search back from each row's column at a time. O(n^3) in all.
"""

from __future__ import annotations

import numpy as np


def shortest_paths(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each column, row potentials, column potentials) of an assignment with the least total; integer costs stay exact."""
    n = len(cost)
    u, v = np.zeros(n, cost.dtype), np.zeros(n, cost.dtype)
    owner = np.full(n, -1)
    far = np.iinfo(cost.dtype).max
    for row in range(n):
        reach = np.full(n, far, cost.dtype)  # length of the shortest path to each column
        before = np.full(n, -1)  # the column before it on that path
        seen = np.zeros(n, bool)
        at, last, done = row, -1, 0
        while True:
            step = done + cost[at] - u[at] - v
            nearer = ~seen & (step < reach)
            reach[nearer], before[nearer] = step[nearer], last
            last = int(np.where(seen, far, reach).argmin())
            done, seen[last] = reach[last], True
            if owner[last] < 0:
                break
            at = owner[last]
        settled = np.flatnonzero(seen & (owner >= 0))
        u[row] += done
        u[owner[settled]] += done - reach[settled]
        v[seen] -= done - reach[seen]
        while last >= 0:
            prior = before[last]
            owner[last] = owner[prior] if prior >= 0 else row
            last = prior
    return owner, u, v


def first_matching(tight: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Column of each row in the lexicographically first perfect matching of `tight`, from any one of them (row of each column)."""
    n = len(tight)
    owner = owner.copy()
    column = np.argsort(owner)
    free = np.ones(n, bool)  # rows whose column may still change
    for row in range(n):
        free[row] = False
        own = column[row]
        smaller = np.flatnonzero(tight[row, :own] & free[owner[:own]])
        if not len(smaller):
            continue
        # back from the column that would be given up: rows that could take it, then the columns these would give up, and so on
        takes = np.full(n, -1)  # column that a row would take
        edge = np.array([own])
        while len(edge):
            found = np.flatnonzero(free & (takes < 0) & tight[:, edge].any(axis=1))
            takes[found] = edge[tight[np.ix_(found, edge)].argmax(axis=1)]
            edge = column[found]
        able = smaller[takes[owner[smaller]] >= 0]
        if not len(able):
            continue
        # the row takes the smallest such column, and each displaced row the one it has a way to
        mover, target = row, int(able[0])
        while True:
            displaced = owner[target]
            owner[target], column[mover] = mover, target
            if target == own:
                break
            mover, target = displaced, takes[displaced]
    return column


def best_assignment(overlap: np.ndarray) -> list[int]:
    """Column for each row of a square matrix of integers with the largest total; among equal totals the lexicographically smallest list."""
    gain = np.asarray(overlap, np.int64)
    if gain.ndim != 2 or gain.shape[0] != gain.shape[1]:
        raise ValueError("the matrix must be square")
    if not len(gain):
        return []
    cost = gain.max() - gain
    owner, u, v = shortest_paths(cost)
    return first_matching(cost - u[:, None] - v == 0, owner).tolist()
