"""Balanced parentheses of a tree in preorder, with a range min-max tree over their excess.

A node is an opening parenthesis, its subtree ends at the matching closing one, a leaf is the
pair "()".  All calls take and return whole numpy arrays, one entry a node.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64


class Parens:
    """``bits``: 1 opens and 0 closes, balanced; several trees may follow each other."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(np.int8)
        self.excess = np.cumsum(2 * self.bits.astype(np.int64) - 1)
        high = np.iinfo(np.int64).max
        padded = np.full(-(-len(bits) // BLOCK) * BLOCK, high)
        padded[:len(bits)] = self.excess
        self.levels = [padded.reshape(-1, BLOCK).min(axis=1)]      # least excess of a block, of two blocks, ...
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            low = np.append(low, high) if len(low) % 2 else low
            self.levels[-1] = low
            self.levels.append(low.reshape(-1, 2).min(axis=1))
        self.opens = np.flatnonzero(self.bits)
        self.closes = self.findclose(self.opens)

    def _scan(self, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First position from ``at`` to the end of its block with the target excess, or -1."""
        out = np.full(len(at), -1, np.int64)
        live, at = np.arange(len(at)), at.copy()
        stop = np.minimum((at // BLOCK + 1) * BLOCK, len(self.excess))
        while len(live):
            live = live[at[live] < stop[live]]
            hit = self.excess[at[live]] == target[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
        return out

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The matching closing position of each opening one: its block is scanned, then the
        tree of least excesses is climbed to the next block that goes low enough, and descended."""
        target = self.excess[opens] - 1
        after = opens + 1
        out = np.where(after % BLOCK == 0, -1, self._scan(np.where(after % BLOCK == 0, opens, after), target))
        left = np.flatnonzero(out < 0)
        node, goal, height = opens[left] // BLOCK, target[left], np.full(len(left), -1)
        live = np.arange(len(left))
        for h, low in enumerate(self.levels[:-1]):
            right = live[node[live] % 2 == 0]
            found = right[low[node[right] + 1] <= goal[right]]
            node[found] += 1
            height[found] = h
            live = live[height[live] < 0]
            node[live] //= 2
        for h in range(len(self.levels) - 2, 0, -1):
            down = np.flatnonzero(height == h)
            node[down] *= 2
            node[down] += self.levels[h - 1][node[down]] > goal[down]
            height[down] = h - 1
        out[left] = self._scan(node * BLOCK, goal)
        return out

    def depths(self) -> np.ndarray:
        return self.excess[self.opens] - 1

    def ends(self) -> np.ndarray:
        """Of each node, the number of the first node after its subtree."""
        return np.arange(len(self.opens)) + (self.closes - self.opens + 1) // 2

    def parents(self) -> np.ndarray:
        """Number of each node's parent, -1 for roots: the last node before it that is one level up."""
        n, depth = len(self.opens), self.depths()
        place = depth * n + np.arange(n)
        order = np.sort(place)
        up = order[np.maximum(np.searchsorted(order, place - n) - 1, 0)] % max(n, 1)
        return np.where(depth > 0, up, -1)

    def leaf_pairs(self, counts: np.ndarray | None = None) -> np.ndarray:
        """Pairs "()" within each node's parentheses, by rank; ``counts``: per node, whether its pair counts."""
        pair = (self.bits == 1) & (np.append(self.bits[1:], 1) == 0)
        if counts is not None:
            pair[self.opens] &= counts
        rank = np.append(0, np.cumsum(pair))
        return rank[self.closes] - rank[self.opens]


def subtree_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each subtree by one cumulative array over the preorder."""
    total = np.append(0, np.cumsum(values))
    return total[ends] - total[:-1]


def subtree_mins(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least value of each subtree: two overlapping spans of a power of two cover it."""
    n = len(values)
    first, size = np.arange(n), ends - np.arange(n)
    power = np.frexp(size.astype(np.float64))[1] - 1
    out, low, width = np.empty(n, values.dtype), values, 1
    for p in range(int(power.max(initial=-1)) + 1):
        asked = power == p
        out[asked] = np.minimum(low[first[asked]], low[ends[asked] - width])
        low = np.minimum(low[:max(len(low) - width, 0)], low[width:])
        width *= 2
    return out
