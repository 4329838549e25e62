"""A hierarchical index over binary codes in Gray order, in numpy.

Codes sorted by Gray rank put similar codes side by side. Each node stands for
a run of neighbours and holds the bits that all of them share. Queries are put
in the same order under nodes of their own. A search walks down both from their
tops, and drops two nodes with all that is below them once they differ in more
of the bits that both share than the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of nodes that go down at once, and pairs found that are handed on together.
MET = 1 << 16


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(s))
    return rank


class PatternTree:
    """Nodes over codes in Gray order: what all codes of a node share, from the codes themselves up to a few nodes."""

    def __init__(self, codes: np.ndarray, fanout: int = 4):
        self.fanout = fanout
        all_and, all_or = codes, codes
        self.levels = [(codes, None)]  # patterns, and which of their bits are shared; a code shares all with itself
        while len(all_and) > fanout:
            at = np.arange(0, len(all_and), fanout)
            all_and, all_or = np.bitwise_and.reduceat(all_and, at), np.bitwise_or.reduceat(all_or, at)
            self.levels.append((all_and, ~(all_and ^ all_or)))

    def below(self, node: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray | None]:
        """The nodes below those of the level, and which of them exist if not all do."""
        down = ((node * np.int32(self.fanout))[:, None] + np.arange(self.fanout, dtype=np.int32)).ravel()
        n = len(self.levels[level - 1][0])
        return down, down < n if n % self.fanout else None


def meetings(a: PatternTree, b: PatternTree, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in a and in b whose codes differ in radius bits at most, in parts.

    Both trees are walked down together: two nodes that differ in more of the
    bits that both share are dropped with all that is below them. At most MET
    pairs of nodes go down at once; the rest waits.
    """
    top_a, top_b = len(a.levels) - 1, len(b.levels) - 1
    n_a, n_b = len(a.levels[top_a][0]), len(b.levels[top_b][0])

    def near(i, j, at_a: int, at_b: int):
        (x, own_a), (y, own_b) = a.levels[at_a], b.levels[at_b]
        bits = x[i] ^ y[j]
        if own_a is not None:
            bits &= own_a[i]
        if own_b is not None:
            bits &= own_b[j]
        ok = np.flatnonzero(np.bitwise_count(bits) <= radius)
        return i[ok], j[ok]

    waiting = [(top_a, top_b, *near(np.repeat(np.arange(n_a, dtype=np.int32), n_b), np.tile(np.arange(n_b, dtype=np.int32), n_a), top_a, top_b))]
    while waiting:
        at_a, at_b, i, j = waiting.pop()
        while len(i) and (at_a or at_b):
            if len(i) > MET:
                waiting.append((at_a, at_b, i[MET:], j[MET:]))
                i, j = i[:MET], j[:MET]
            if at_b and (not at_a or top_b - at_b <= top_a - at_a):  # in step from the tops, so that the nodes of a small tree meet wide ones
                (j, there), i = b.below(j, at_b), np.repeat(i, b.fanout)
                at_b -= 1
            else:
                (i, there), j = a.below(i, at_a), np.repeat(j, a.fanout)
                at_a -= 1
            if there is not None:
                i, j = i[there], j[there]
            i, j = near(i, j, at_a, at_b)
        if len(i):
            yield i, j


class GrayIndex:
    """All pairs of queries and codes at radius or fewer differing bits."""

    def __init__(self, codes: np.ndarray, leaf: int = 4):
        self.order, self.leaf = np.argsort(gray_rank(codes), kind="stable"), leaf
        self.tree = PatternTree(self._sorted(codes, self.order), leaf)

    @staticmethod
    def _sorted(codes: np.ndarray, order: np.ndarray) -> np.ndarray:
        codes = codes[order].astype(np.uint64)
        return codes.astype(np.uint32) if codes.max() < 2**32 else codes  # half as much to read

    def search(self, queries: np.ndarray, radius: int, chunk: int = MET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Parts of (index of the query, index of the code as given); queries are put in Gray order too, and near ones go down as one."""
        if not len(queries):
            return
        order = np.argsort(gray_rank(queries), kind="stable")
        found, held = [], 0

        def given():
            return order[np.concatenate([q for q, _ in found])], self.order[np.concatenate([at for _, at in found])]

        for part in meetings(PatternTree(self._sorted(queries, order), self.leaf), self.tree, radius):
            found.append(part)
            held += len(part[0])
            if held >= chunk:
                yield given()
                found, held = [], 0
        if found:
            yield given()


def unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the classes of u[i] and v[i]; label[x] is the smallest member of x's class."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def spanning(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Merges classes like unite(), and gives the pairs (u[i], v[i]) that did so: a spanning forest."""
    out = []
    while True:
        apart = label[u] != label[v]
        if not apart.any():
            return out
        u, v = u[apart], v[apart]
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        high, first = np.unique(high, return_index=True)
        label_of = np.arange(label.max() + 1)
        label_of[high] = low[first]
        out.append((u[first], v[first]))
        while not np.array_equal(up := label_of[label_of], label_of):
            label_of = up
        label[:] = label_of[label]
