"""Local components of the links that one task has found."""

from __future__ import annotations

import numpy as np


def join_roots(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``root`` after linking u[i] with v[i] for every i: each node's root is the smallest node of its component."""
    while True:
        ru, rv = root[u], root[v]
        if (ru == rv).all():
            return root
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while (root[root] != root).any():
            root = root[root]
