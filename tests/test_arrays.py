"""Kernels on compact adjacency give what those on sets and maps give."""

import random
import time

import numpy as np
import pytest
from graphs import made, mapping, random_edges, rows

from arcweave.kernels import arrays, classes
from arcweave.kernels import coloring as ck
from arcweave.operators import coloring


def csr(edges, both=True, size=3):
    """Arcs in small batches, ordered by source; vertices are numbered by their ids where each has an arc."""
    arcs = sorted({(u, v) for u, v in edges} | ({(v, u) for u, v in edges} if both else set()))
    held = arrays.Arcs()
    for k in range(0, len(arcs), size):
        part = np.array(arcs[k : k + size])
        held.add(part[:, 0], part[:, 1])
    return held.close()


def sets(n):
    g = {v: set() for v in range(n.size)}
    for u, v in zip(n.sources().tolist(), n.to.tolist(), strict=True):
        g[u].add(v)
    return g


def plain(draw, most=14, m=40):
    n = draw.randint(2, most)
    edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(draw.randint(1, m))]
    return csr(edges).without_loops()


PAIRS = {
    "dsatur": (ck.dsatur_scan, classes.dsatur),
    "dsatur_recompute": (ck.dsatur_heap, lambda n: classes.dsatur(n, False)),
    "rlf": (ck.rlf, classes.rlf),
    "anneal": (lambda g, r: ck.anneal(g, r, 3, 300), lambda n: classes.anneal(n, 3, 300)),
    "anneal_partial": (lambda g, r: ck.anneal(g, r, 3, 300, True), lambda n: classes.anneal(n, 3, 300, True)),
}


@pytest.mark.parametrize("name", PAIRS)
def test_colorings_equal_those_on_sets(name):
    draw, (slow, fast) = random.Random(4), PAIRS[name]
    for k in range(80):
        n = plain(draw) if k % 2 else plain(draw, 40, 300)
        colors = slow(sets(n), {v: v for v in range(n.size)})
        assert fast(n) == [colors[v] for v in range(n.size)]


def test_tabu_moves_are_kept_up_to_date():
    draw = random.Random(5)
    for _ in range(60):
        n = plain(draw, 40, 200)
        k = max(2, max(classes.dsatur(n)))
        moves = classes._Moves(n, np.array([draw.randrange(k) for _ in range(n.size)], dtype=np.int32), k)
        for step in range(60):
            beside = [moves.colors[n.to[n.start[v] : n.start[v + 1]]].tolist() for v in range(n.size)]
            same = [x.count(moves.colors[v]) for v, x in enumerate(beside)]
            assert moves.cost == sum(same) // 2
            open_ = {(v, c): beside[v].count(c) - same[v] for v in range(n.size) if same[v] for c in range(k) if c != moves.colors[v]}
            open_ = {m: x for m, x in open_.items() if moves.until.get(m, -1) < step or moves.cost + x == 0}
            found = moves.pick(step, draw) if moves.cost else None
            if found is None:
                assert not open_
                break
            assert open_[found[1:]] == found[0] == min(open_.values())
            moves.take(*found, step + draw.randrange(12))
        colors = np.array(classes.tabu(n, 3, 100))
        assert (colors[n.sources()] != colors[n.to]).all() and set(colors.tolist()) == set(range(colors.max() + 1)) and colors.max() <= max(classes.dsatur(n))


def sparse(n, seed=0):
    draw = random.Random(seed)
    return csr([(v, draw.randrange(n)) for v in range(n) for _ in range(2)], size=1000).without_loops()


@pytest.mark.parametrize("name", [*PAIRS, "tabu"])
def test_colorings_of_many_vertices_take_seconds(name):
    """Scans of all vertices a step take minutes here."""
    n = sparse(30_000)
    slow = {"anneal": lambda n: classes.anneal(n, 3), "anneal_partial": lambda n: classes.anneal(n, 3, partial=True), "tabu": lambda n: classes.tabu(n, 3)}
    start = time.time()
    colors = np.array((slow.get(name) or PAIRS[name][1])(n))
    assert time.time() - start < 30
    assert (colors[n.sources()] != colors[n.to]).all() and colors.min() == 0


@pytest.mark.parametrize("method", ["dsatur", "dsatur_heap", "dsatur_recompute", "rlf", "anneal", "anneal_partial", "tabu"])
def test_colorings_have_no_limit_of_edges(spark, method, monkeypatch):
    from arcweave.plans import kernels

    monkeypatch.setattr(kernels, "KERNEL_MAX_EDGES", 5)
    edges = [(u, v, w, k) for u, v, w, k in random_edges(random.Random(8))]
    edges += [(u + 50, v + 50, w, k + 100) for u, v, w, k in random_edges(random.Random(9))] + [(99, 99, 1.0, 500)]
    g = made(spark, edges, False)
    found = coloring.color(g, method)
    assert mapping(found)[99] == 0
    assert rows(coloring.coloring_report(g, found), "contiguous", "conflicts", "uncolored") == [(True, 0, 0)]
