"""Numpy helpers for links found within a tile."""

from __future__ import annotations

import numpy as np


def roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For n items linked pairwise by i and j: of each, the least item it is connected with."""
    lab = np.arange(n)
    while len(i):
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab
