"""Vertex coloring of one component: ``{v: set of neighbours}`` without loops; ties go to the smaller rank."""

from __future__ import annotations

import random
from collections.abc import Iterable
from heapq import heapify, heappop, heappush

Neighbours = dict[int, set[int]]


def first_free(used: Iterable[int]) -> int:
    used, c = set(used), 0
    while c in used:
        c += 1
    return c


def greedy(g: Neighbours, order: Iterable[int]) -> dict[int, int]:
    colors: dict[int, int] = {}
    for v in order:
        colors[v] = first_free(colors[u] for u in g[v] if u in colors)
    return colors


def dsatur_scan(g: Neighbours, rank: dict[int, int]) -> dict[int, int]:
    """Most saturated, then most uncolored neighbours, then rank; found by a scan."""
    colors: dict[int, int] = {}
    left = sorted(g, key=rank.__getitem__)
    while left:
        v = max(left, key=lambda u: (len({colors[x] for x in g[u] if x in colors}), sum(x not in colors for x in g[u]), -rank[u]))
        colors[v] = first_free(colors[x] for x in g[v] if x in colors)
        left.remove(v)
    return colors


def dsatur_heap(g: Neighbours, rank: dict[int, int], incremental: bool = True) -> dict[int, int]:
    """As :func:`dsatur_scan`, from a heap; neighbour colors are kept or recomputed."""
    colors: dict[int, int] = {}
    seen: dict[int, set[int]] = {v: set() for v in g}
    open_ = {v: len(g[v]) for v in g}
    key = {v: (0, -open_[v], rank[v]) for v in g}
    heap = [(key[v], v) for v in g]
    heapify(heap)
    while heap:
        k, v = heappop(heap)
        if v in colors or k != key[v]:
            continue
        colors[v] = first_free(seen[v] if incremental else (colors[x] for x in g[v] if x in colors))
        for u in g[v]:
            if u not in colors:
                open_[u] -= 1
                if incremental:
                    seen[u].add(colors[v])
                saturation = len(seen[u]) if incremental else len({colors[x] for x in g[u] if x in colors})
                key[u] = (-saturation, -open_[u], rank[u])
                heappush(heap, (key[u], u))
    return colors


def rlf(g: Neighbours, rank: dict[int, int]) -> dict[int, int]:
    """Recursive largest first: grow a class by most neighbours next to it, then fewest open neighbours."""
    colors: dict[int, int] = {}
    left, color = set(g), 0
    while left:
        v = min(left, key=lambda u: (-len(g[u] & left), rank[u]))
        members, free, beside = {v}, left - g[v] - {v}, g[v] & left
        while free:
            v = min(free, key=lambda u: (-len(g[u] & beside), len(g[u] & free), rank[u]))
            members.add(v)
            beside |= g[v] & free
            free -= g[v] | {v}
        for v in members:
            colors[v] = color
        left -= members
        color += 1
    return colors


def conflicts(g: Neighbours, colors: dict[int, int]) -> int:
    return sum(colors.get(u) == c for v, c in colors.items() for u in g[v]) // 2


def renumber(colors: dict[int, int]) -> dict[int, int]:
    names = {c: k for k, c in enumerate(sorted(set(colors.values())))}
    return {v: names[c] for v, c in colors.items()}


def anneal(g: Neighbours, rank: dict[int, int], seed: int = 0, steps: int = 4000, partial: bool = False) -> dict[int, int]:
    """Simulated annealing for ever fewer colors, from DSatur; complete or partial solutions.

    Complete: every vertex has a color, the cost is conflicts. Partial: no
    conflicts, the cost is uncolored vertices; coloring one uncolors its rivals.
    """
    best = dsatur_heap(g, rank)
    draw = random.Random(seed)
    vertices = sorted(g, key=rank.__getitem__)
    while (k := max(best.values(), default=0)) > 0:
        colors: dict[int, int] = {v: (best[v] if best[v] < k else -1 if partial else draw.randrange(k)) for v in vertices}
        heat, cost = 1.0, sum(c < 0 for c in colors.values()) if partial else conflicts(g, colors)
        for _ in range(steps):
            if not cost:
                break
            if partial:
                v, c = draw.choice([x for x in vertices if colors[x] < 0]), draw.randrange(k)
                rivals = [u for u in g[v] if colors[u] == c]
                change = len(rivals) - 1
            else:
                v, c = draw.choice(vertices), draw.randrange(k)
                rivals, change = [], sum(colors[u] == c for u in g[v]) - sum(colors[u] == colors[v] for u in g[v])
            if change <= 0 or draw.random() < 2.718281828 ** (-change / heat):
                colors[v] = c
                for u in rivals:
                    colors[u] = -1
                cost += change
            heat = max(0.02, heat * 0.999)
        if cost:
            break
        best = renumber(colors)
    return best


def tabu(g: Neighbours, rank: dict[int, int], seed: int = 0, steps: int = 2000) -> dict[int, int]:
    """Tabu search over conflicting vertices, for ever fewer colors, from DSatur."""
    best = dsatur_heap(g, rank)
    draw = random.Random(seed)
    vertices = sorted(g, key=rank.__getitem__)
    while (k := max(best.values(), default=0)) > 0:
        colors = {v: best[v] if best[v] < k else draw.randrange(k) for v in vertices}
        cost, until = conflicts(g, colors), {}
        for step in range(steps):
            if not cost:
                break
            moves = []
            for v in vertices:
                now = sum(colors[u] == colors[v] for u in g[v])
                if now:
                    for c in range(k):
                        change = sum(colors[u] == c for u in g[v]) - now
                        if c != colors[v] and (until.get((v, c), -1) < step or cost + change == 0):
                            moves.append((change, draw.random(), v, c))
            if not moves:
                break
            change, _, v, c = min(moves)
            until[v, colors[v]] = step + 7 + draw.randrange(10) + cost
            colors[v] = c
            cost += change
        if cost:
            break
        best = renumber(colors)
    return best


def ants(g: Neighbours, rank: dict[int, int], seed: int = 0, rounds: int = 10, size: int = 5, alpha: float = 2.0, keep: float = 0.75) -> dict[int, int]:
    """Ant colony: trails between vertices that shared a class guide how classes grow; trails evaporate."""
    draw = random.Random(seed)
    vertices = sorted(g, key=rank.__getitem__)
    trail: dict[tuple[int, int], float] = {}
    best = dsatur_heap(g, rank)
    for _ in range(rounds):
        laid: dict[tuple[int, int], float] = {}
        for _ in range(size):
            colors: dict[int, int] = {}
            left, color = set(vertices), 0
            while left:
                free, members = set(left), []
                while free:
                    options = sorted(free, key=rank.__getitem__)
                    weights = []
                    for v in options:
                        shared = sum(trail.get((min(u, v), max(u, v)), 1.0) for u in members) / len(members) if members else 1.0
                        weights.append(shared**alpha * (1 + len(g[v] & left)))
                    v = draw.choices(options, weights)[0]
                    members.append(v)
                    free -= g[v] | {v}
                for v in members:
                    colors[v] = color
                left -= set(members)
                color += 1
            if color < max(best.values(), default=-1) + 1:
                best = dict(colors)
            for v in vertices:
                for u in vertices:
                    if u < v and colors[u] == colors[v]:
                        laid[u, v] = laid.get((u, v), 0.0) + 1.0 / color
        trail = {p: keep * trail.get(p, 1.0) + laid.get(p, 0.0) for p in trail.keys() | laid.keys()}
    return best


def exact(g: Neighbours, rank: dict[int, int], most: int = 40) -> dict[int, int]:
    """A coloring with the fewest colors, by branch and bound; for at most ``most`` vertices."""
    if len(g) > most:
        raise ValueError(f"exact coloring takes components of at most {most} vertices, not {len(g)}")
    best = dsatur_heap(g, rank)
    top = [max(best.values(), default=-1) + 1]
    colors: dict[int, int] = {}

    def extend(used: int) -> None:
        nonlocal best
        if used >= top[0]:
            return
        if len(colors) == len(g):
            best, top[0] = dict(colors), used
            return
        v = max((u for u in g if u not in colors), key=lambda u: (len({colors[x] for x in g[u] if x in colors}), len(g[u]), -rank[u]))
        taken = {colors[x] for x in g[v] if x in colors}
        for c in range(min(used + 1, top[0] - 1)):
            if c not in taken:
                colors[v] = c
                extend(max(used, c + 1))
                del colors[v]

    extend(0)
    return best


def iterated(g: Neighbours, rank: dict[int, int], rounds: int = 20, seed: int = 0) -> dict[int, int]:
    """Greedy again and again with the classes of the last coloring reordered: largest first, reversed or at random."""
    draw = random.Random(seed)
    best = greedy(g, sorted(g, key=rank.__getitem__))
    for k in range(rounds):
        classes: dict[int, list[int]] = {}
        for v in sorted(best, key=rank.__getitem__):
            classes.setdefault(best[v], []).append(v)
        names = sorted(classes)
        if k % 3 == 0:
            names.sort(key=lambda c: (-len(classes[c]), c))
        elif k % 3 == 1:
            names.reverse()
        else:
            draw.shuffle(names)
        best = greedy(g, [v for c in names for v in classes[c]])
    return best
