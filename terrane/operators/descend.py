"""Trees as node tables that rows of a matrix walk down together: numpy on Arrow batches.

A table is a few numbers for each node, so a model of a million nodes is some tens of MB in a function that the executors
get once, while an expression with a branch for each node would not compile."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Nodes:
    """Arrays by node number: feature (-1 in a leaf), threshold, left and right child, depth, value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The node that each row ends in, at `depth` at the latest. Missing values (NaN) go right."""
        at = np.zeros(len(x), dtype=np.int64)
        live = np.arange(len(x))
        while len(live):
            node = at[live]
            go = self.feature[node] >= 0
            if depth is not None:
                go &= self.depth[node] < depth
            live, node = live[go], node[go]
            low = x[live, self.feature[node]] <= self.threshold[node]
            at[live] = np.where(low, self.left[node], self.right[node])
        return at

    def effects(self, x: np.ndarray, features: int) -> np.ndarray:
        """By row and feature: the changes of the value along the path that the feature's splits cause."""
        out, at, live = np.zeros((len(x), features)), np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while len(live):
            go = self.feature[at[live]] >= 0
            live = live[go]
            node = at[live]
            f = self.feature[node]
            new = np.where(x[live, f] <= self.threshold[node], self.left[node], self.right[node])
            np.add.at(out, (live, f), self.value[new] - self.value[node])
            at[live] = new
        return out
