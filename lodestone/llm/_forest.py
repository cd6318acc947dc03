"""A spanning forest of links found in one task, so that a group of copies costs its size and not its square."""

from __future__ import annotations

import numpy as np


class Forest:
    """Union-find over 0..n-1 that takes links in bulk."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As `add`; the places of the links that joined two trees, earlier ones before later ones of the same trees."""
        at, used = np.arange(len(a)), []
        while True:
            ra, rb = self.root[a[at]], self.root[b[at]]
            apart = ra != rb
            if not apart.any():
                return np.concatenate(used) if used else at[:0]
            at, high, low = at[apart], np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart]
            np.minimum.at(self.root, high, low)
            won = np.flatnonzero(self.root[high] == low)
            used.append(at[won[np.unique(high[won], return_index=True)[1]]])
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A link from every node that has another root to that root."""
        node = np.flatnonzero(self.root != np.arange(len(self.root)))
        return node, self.root[node]
