"""Medians of many stretches of one array."""

from __future__ import annotations

import numpy as np


def stretch_medians(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The interpolated median of values[low:high] for each pair of bounds; NaN for an empty stretch.

    Ranks are looked at bit by bit, from the highest: where the values with a 0 come first, in their order, counts of
    them say how many lie in a stretch, on which side its median is and where the stretch goes on. A stretch costs a step
    for each bit, however long it is.
    """
    out, ask = np.full(len(low), np.nan), np.flatnonzero(high > low)
    if not len(ask):
        return out
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    n = (high - low)[ask]
    a, b, k = np.tile(low[ask], 2), np.tile(high[ask], 2), np.concatenate([(n - 1) // 2, n // 2])
    found = np.zeros(len(k), np.int64)
    for bit in reversed(range(int(len(values) - 1).bit_length())):
        one = (rank >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        before, upto = zeros[a], zeros[b]
        right = k >= upto - before
        k -= np.where(right, upto - before, 0)
        a, b = np.where(right, zeros[-1] + a - before, before), np.where(right, zeros[-1] + b - upto, upto)
        found |= right.astype(np.int64) << bit
        rank = np.concatenate([rank[~one], rank[one]])
    middle = values[order[found]]
    out[ask] = (middle[: len(ask)] + middle[len(ask) :]) / 2
    return out
