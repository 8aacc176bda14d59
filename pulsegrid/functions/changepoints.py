"""Exact penalised changepoint search for shifts of level (pruned exact linear time), in NumPy."""

from __future__ import annotations

import numpy as np


def segments(values: np.ndarray, penalty: float) -> np.ndarray:
    """Start indices of the segments that minimise the squared deviations from segment means plus ``penalty`` per segment.

    The search is exact: candidates are pruned only where they can't begin the last segment of any longer optimum.
    """
    n = len(values)
    if n == 0:
        return np.empty(0, np.int64)
    s1, s2 = np.concatenate([[0.0], np.cumsum(values)]), np.concatenate([[0.0], np.cumsum(values * values)])
    best = np.empty(n + 1)
    best[0] = -penalty
    came = np.zeros(n + 1, np.int64)
    live = np.array([0])
    for end in range(1, n + 1):
        total, size = s1[end] - s1[live], end - live
        cost = np.maximum(s2[end] - s2[live] - total * total / size, 0.0)
        full = best[live] + cost
        k = int(np.argmin(full))
        best[end], came[end] = full[k] + penalty, live[k]
        live = np.append(live[full <= best[end]], end)
    out, end = [], n
    while end > 0:
        out.append(came[end])
        end = came[end]
    return np.array(out[::-1], np.int64)


def segment_levels(values: np.ndarray, penalty: float) -> np.ndarray:
    """The mean of its segment for every value."""
    cuts = segments(values, penalty)
    sizes = np.diff(np.append(cuts, len(values)))
    return np.repeat(np.add.reduceat(values, cuts) / sizes, sizes) if len(values) else values
