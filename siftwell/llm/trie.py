"""A double-array trie over sequences of small codes, walked from many places at once with numpy."""

from __future__ import annotations

import numpy as np

#: Free places that are looked at together, and how often, before a node's children are put at the end of the arrays.
WIDE, TRIES = 8192, 6


class Trie:
    """Sequences of codes from 1 on, a row each, filled up with zeros.

    The child of node s by code c is t = base[s] + c if check[t] is s. root is the
    node of the empty sequence, nodes[k] that of the k-th. The arrays are padded so
    that each node's base plus each code up to codes is a place in them.
    """

    def __init__(self, sequences: np.ndarray) -> None:
        self.codes = int(sequences.max(initial=0))
        parent, code, ends = self._plain(sequences)
        place, base = self._placed(parent, code)
        self.size = int(place.max()) + 2 * self.codes + 1
        self.base, self.check = np.zeros(self.size, dtype=np.int32), np.full(self.size, -1, dtype=np.int32)
        self.base[place] = base
        self.check[place[1:]] = place[parent[1:]]
        self.root, self.nodes = int(place[0]), place[ends]

    @staticmethod
    def _plain(sequences: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parent and code of each node, brothers one after the other, and the node of each sequence; node 0 is the root."""
        n, width = sequences.shape
        order = np.lexsort(sequences.T[::-1]) if n else np.zeros(0, dtype=np.int64)
        rows, at = sequences[order], np.zeros(n, dtype=np.int64)  # at: each row's node so far
        parents, codes, known = [np.array([-1])], [np.array([0])], 1
        for d in range(width):
            there = np.flatnonzero(rows[:, d] > 0)
            own, above = rows[there, d], at[there]
            new = np.ones(len(there), dtype=bool)
            new[1:] = (own[1:] != own[:-1]) | (above[1:] != above[:-1])
            parents.append(above[new])
            codes.append(own[new])
            at[there] = known + np.cumsum(new) - 1
            known += int(new.sum())
        ends = np.empty(n, dtype=np.int64)
        ends[order] = at
        return np.concatenate(parents), np.concatenate(codes).astype(np.int64), ends

    def _placed(self, parent: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and base of each node; those of many children are served first, only children get what is free then."""
        n = len(parent)
        used = np.zeros(2 * n + 2 * self.codes + WIDE, dtype=bool)
        used[: self.codes + 1] = True  # so that no base is negative
        place, base = np.full(n, self.codes, dtype=np.int64), np.zeros(n, dtype=np.int64)
        first = np.flatnonzero(np.concatenate([[True], parent[2:] != parent[1:-1]])) + 1 if n > 1 else np.zeros(0, dtype=np.int64)
        count = np.diff(np.append(first, n))
        top, start, last = self.codes + 1, self.codes + 1, 0
        for k in np.argsort(-count, kind="stable").tolist():
            a, m = int(first[k]), int(count[k])
            if m == 1:
                break
            steps = code[a : a + m] - code[a]  # rising
            if m < last // 2 or not last:  # fewer children may fit where more did not
                start, last = self.codes + 1, m
            found, at = -1, start
            for _ in range(TRIES):
                if at >= top:
                    break
                fit = at + np.flatnonzero(~used[at : at + WIDE])
                for step in steps[1:].tolist():
                    fit = fit[~used[fit + step]]
                    if not len(fit):
                        break
                if len(fit):
                    found = int(fit[0])
                    break
                at += WIDE
            if found < 0:
                found, start = top, max(start, at - WIDE)
            place[a : a + m] = found + steps
            used[found + steps] = True
            base[parent[a]] = found - code[a]
            top = max(top, found + int(steps[-1]) + 1)
            if top + WIDE + 2 * self.codes > len(used):
                used = np.concatenate([used, np.zeros(len(used), dtype=bool)])
        only = first[count == 1]
        free = np.flatnonzero(~np.concatenate([used[:top], np.zeros(len(only), dtype=bool)]))[: len(only)]
        place[only], base[parent[only]] = free, free - code[only]
        return place, base

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes by codes (0: none): which of them exist, and those that do."""
        to = self.base[nodes] + codes
        there = np.flatnonzero((self.check[to] == nodes) & (codes > 0))
        return there, to[there]
