"""The lattice E8: nearest points, neighbouring cells."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np


def nearest(y: np.ndarray) -> np.ndarray:
    """Nearest point of E8 to each row of ``y`` (n, 8): the nearer of those in D8 and in D8 + 1/2."""
    even, odd = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    closer = ((y - odd) ** 2).sum(1) < ((y - even) ** 2).sum(1)
    return np.where(closer[:, None], odd, even)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum: round, and if the sum is odd round the worst coordinate the other way."""
    p = np.rint(y)
    wrong = (p.sum(1) % 2) != 0
    gap = y - p
    worst = np.abs(gap).argmax(1)
    rows = np.flatnonzero(wrong)
    at = worst[rows]
    p[rows, at] += np.where(gap[rows, at] >= 0, 1.0, -1.0)
    return p


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, which point at the neighbouring cells."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(v) for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)
