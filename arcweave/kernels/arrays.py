"""Compact adjacency of one group of arcs: targets by source, 4 bytes an arc, vertices numbered from 0."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Arcs that vectorised steps look at at once, so that their scratch memory stays small.
BLOCK = 1 << 20


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest of 1, 4 and 8 bytes that holds them; other numbers as they are."""
    if not len(x) or (x.dtype.kind == "f" and not (np.isfinite(x).all() and (x == np.trunc(x)).all())):
        return x
    low, high = x.min(), x.max()
    for kind in (np.int8, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


class Arcs:
    """Collects arcs that come ordered by source, a batch at a time."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.dst: list[np.ndarray] = []
        self.weight: list[np.ndarray] = []

    def add(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray | None = None) -> None:
        first = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
        ids, counts = src[first], np.diff(np.r_[first, len(src)])
        if self.ids and self.ids[-1][-1] == ids[0]:
            self.counts[-1][-1] += counts[0]
            ids, counts = ids[1:], counts[1:]
        if len(ids):
            self.ids.append(ids)
            self.counts.append(counts)
        self.dst.append(narrow(dst))
        if weight is not None:
            self.weight.append(narrow(weight))

    def close(self) -> Csr:
        """Vertices in order of their first arc out, then those without one by id. The batches are given up."""
        ids = np.concatenate(self.ids).astype(np.int64)
        counts = np.concatenate(self.counts)
        order = np.argsort(ids, kind="stable")
        known = ids[order]
        more = []
        for x in self.dst:
            x = np.unique(x)
            at = np.minimum(np.searchsorted(known, x), len(known) - 1)
            more.append(x[known[at] != x])
        more = np.unique(np.concatenate(more)).astype(np.int64)
        n = len(ids) + len(more)
        ids, start = np.r_[ids, more], np.zeros(n + 1, np.int64)
        np.cumsum(counts, out=start[1 : len(counts) + 1])
        start[len(counts) + 1 :] = start[len(counts)]
        order = np.argsort(ids, kind="stable").astype(np.int32)
        known = ids[order]
        to, at = np.empty(start[-1], np.int32), 0
        self.dst.reverse()
        while self.dst:
            x = self.dst.pop()
            to[at : at + len(x)] = order[np.searchsorted(known, x.astype(np.int64))]
            at += len(x)
        weight = np.concatenate(self.weight) if self.weight else None
        self.weight.clear()
        return Csr(ids, start, to, weight)


class Csr:
    """``to[start[u]:start[u + 1]]`` are the targets of vertex u, whose name is ``ids[u]``."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, to: np.ndarray, weight: np.ndarray | None = None) -> None:
        self.ids, self.start, self.to, self.weight = ids, start, to, weight

    @property
    def size(self) -> int:
        return len(self.ids)

    def find(self, name: int) -> int:
        """The number of a vertex, or -1."""
        at = np.flatnonzero(self.ids == name)
        return int(at[0]) if len(at) else -1

    def sources(self) -> np.ndarray:
        """The source of each arc."""
        return np.repeat(np.arange(self.size, dtype=np.int32), np.diff(self.start))

    def without_loops(self) -> Csr:
        tail = self.sources()
        keep = tail != self.to
        if keep.all():
            return self
        start = np.r_[0, np.cumsum(np.bincount(tail[keep], minlength=self.size))]
        return Csr(self.ids, start, self.to[keep], None if self.weight is None else self.weight[keep])


def spread(start: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, place) of the arcs of some vertices, about :data:`BLOCK` at a time."""
    lengths = start[nodes + 1] - start[nodes]
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(nodes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, "right")))
        n = lengths[lo:hi]
        before = np.cumsum(n) - n
        yield np.repeat(nodes[lo:hi], n), np.arange(n.sum()) + np.repeat(start[nodes[lo:hi]] - before, n)
        lo = hi


def by_target(n: Csr) -> tuple[np.ndarray, np.ndarray]:
    """(arcs ordered by target, where each target's begin); arcs are sorted :data:`BLOCK` at a time, so that no index of all of them is made besides the result."""
    count = np.zeros(n.size, np.int64)
    for lo in range(0, len(n.to), BLOCK):
        count += np.bincount(n.to[lo : lo + BLOCK], minlength=n.size)
    start = np.r_[0, np.cumsum(count)]
    into, place = np.empty(len(n.to), np.int32 if len(n.to) < 1 << 31 else np.int64), start[:-1].copy()
    for lo in range(0, len(n.to), BLOCK):
        order = np.argsort(n.to[lo : lo + BLOCK], kind="stable")
        v = n.to[lo : lo + BLOCK][order]
        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        lengths = np.diff(np.r_[first, len(v)])
        into[np.repeat(place[v[first]] - first, lengths) + np.arange(len(v))] = order + lo
        place[v[first]] += lengths
    return into, start
