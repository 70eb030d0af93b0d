"""Searches, flows and matchings on compact adjacency give what those on maps give, and have no limit of edges."""

import random
import time

import numpy as np
import pytest
from graphs import FLOWS, graph, made, random_edges, rows
from test_arrays import csr, plain, sets, sparse

from arcweave.kernels import arrays, walks
from arcweave.kernels import flow as fk
from arcweave.kernels import search as sk
from arcweave.operators import coloring, flow, matching, traversal


@pytest.fixture
def unlimited(monkeypatch):
    from arcweave.plans import kernels

    monkeypatch.setattr(kernels, "KERNEL_MAX_EDGES", 5)
    monkeypatch.setattr("arcweave.graph.KERNEL_MAX_EDGES", 5)


def weighted(arcs):
    held = arrays.Arcs()
    for u, v, w in sorted(arcs):
        held.add(np.array([u]), np.array([v]), np.array([w]))
    return held.close()


def test_depth_first_search(spark, unlimited):
    draw = random.Random(6)
    for k in range(8):
        edges = random_edges(draw)
        g = made(spark, edges, bool(k % 2))
        kept = [tuple(r) for r in g.edges.select("src", "dst", "weight", "ord").collect()]
        root = kept[0][0]
        columns = list(zip(*kept, strict=True))
        arcs = sk.adjacency(*columns, not g.directed)
        assert rows(traversal.dfs(g, root)) == sorted(sk.dfs(arcs, root))


def test_depth_first_search_of_a_long_path():
    n = csr([(v, v + 1) for v in range(200_000)], False, 10_000)
    order, parent, last = walks.dfs(n, 0)
    assert order.tolist() == list(range(200_001)) and parent[1:].tolist() == last[1:].tolist() == list(range(200_000))


@pytest.mark.parametrize("method", ["edmonds_karp", "dinitz", "preflow"])
def test_flows_on_arrays(method):
    draw = random.Random(1)
    for k in range(150):
        arcs = list({(u, v): (u, v, w + (0.5 if k % 3 == 0 else 0)) for u, v, w, _ in random_edges(draw)}.values())
        n = weighted(arcs)
        s, t = n.find(arcs[0][0]), n.find(draw.choice(arcs)[1])
        r = walks.network(n)
        getattr(walks, method)(r, s, t)
        tail, f = r.tail, r.flow.astype(float)
        assert (r.flow >= 0).all() and (r.room >= 0).all()
        net = np.bincount(tail, f, n.size) - np.bincount(n.to, f, n.size)
        assert not np.delete(net, [s, t]).any()
        if s != t:
            old = fk.Network(arcs)
            fk.edmonds_karp(old, int(n.ids[s]), int(n.ids[t]))
            flows = old.flows()
            assert net[s] == sum(x * (int(u == n.ids[s]) - int(v == n.ids[s])) for x, (u, v, _) in zip(flows, arcs, strict=True))


def test_preflow_of_many_vertices_takes_seconds():
    """Raising heights from 0 by one takes minutes here: most of the flow has to go back."""
    draw = random.Random(2)
    n = weighted([(v, u, float(draw.randint(1, 50))) for v in range(20_000) for u in {draw.randrange(20_000) for _ in range(2)} - {v}])
    start = time.time()
    values = []
    for solve in (walks.preflow, walks.dinitz):
        r = walks.network(arrays.Csr(n.ids, n.start, n.to, n.weight))
        solve(r, 0, int(n.to[-1]))
        values.append(int(r.flow[r.tail == 0].sum(dtype=int) - r.flow[n.to == 0].sum(dtype=int)))
    assert values[0] == values[1] > 0 and time.time() - start < 20


@pytest.mark.parametrize("method", ["edmonds_karp", "dinitz", "preflow"])
def test_flows_have_no_limit_of_edges(spark, method, unlimited):
    text, value, _ = FLOWS["flow9a"]
    assert rows(flow.flow_report(flow.max_flow(graph(spark, text), 0, 1, method), 0, 1)) == [(float(value), 0, 0)]


def test_hopcroft_karp_is_largest():
    draw = random.Random(9)
    for k in range(300):
        a, b = draw.randint(1, 9), draw.randint(1, 9)
        arcs = {u: [v for v in range(b) if draw.random() < (0.15, 0.3)[k % 2]] for u in range(a)}
        pairs = [(2 * u, 2 * v + 1) for u in arcs for v in arcs[u]]
        if pairs:
            n = csr(pairs, False)
            partner = walks.hopcroft_karp(n)
            assert all(partner[partner[v]] == v for v in range(n.size) if partner[v] >= 0)
            assert all((n.ids[u], n.ids[partner[u]]) in pairs for u in range(n.size) if partner[u] >= 0 and n.ids[u] % 2 == 0)
            assert (partner >= 0).sum() == 2 * len(fk.hopcroft_karp(arcs))


@pytest.mark.parametrize("method", ["hopcroft_karp", "flow"])
def test_matchings_have_no_limit_of_edges(spark, method, unlimited):
    g = made(spark, [(u, (u * u + k) % 7, 0.0, 9 * u + k) for u in range(12) for k in range(2)])
    assert rows(matching.matching_report(g, matching.bipartite_matching(g, method))) == [(6, 0, 0)]


def test_blocks():
    draw = random.Random(12)
    for _ in range(200):
        n = plain(draw)
        g = sets(n)
        reached, todo = {0}, [0]
        while todo:
            new = g[todo.pop()] - reached
            reached |= new
            todo += new
        n = csr([(u, v) for u in reached for v in g[u]] or [(0, 0)]).without_loops()
        g = sets(n)
        edges = [(u, v) for u in g for v in g[u] if u < v]
        found = [set(b.tolist()) for b in walks.blocks(n)]
        old = sk.lowpoints(sk.adjacency([u for u, _ in edges], [v for _, v in edges], [0.0] * len(edges), range(len(edges)), True))[2]
        assert sorted(map(sorted, found)) == sorted(sorted({v for e in b for v in e}) for b in old) or not edges
        for k in range(1, len(found)):
            assert len(found[k] & set.union(*found[:k])) == 1


def test_coloring_by_blocks_has_no_limit_of_edges(spark, unlimited):
    edges = [(v, u, 0.0, 9 * v + u) for b in range(0, 40, 4) for v in range(b, b + 5) for u in range(v + 1, b + 5)]
    g = made(spark, edges, False)
    assert rows(coloring.coloring_report(g, coloring.color_by_blocks(g)))[0] == (5, True, 0, 0)


def test_blocks_of_many_vertices_take_seconds():
    start = time.time()
    n = sparse(30_000)
    assert walks.blocks(n) and time.time() - start < 20


def test_arcs_by_target(monkeypatch):
    monkeypatch.setattr(arrays, "BLOCK", 7)
    draw = random.Random(12)
    for _ in range(40):
        n = plain(draw, 20, 60)
        into, start = arrays.by_target(n)
        assert into.tolist() == np.argsort(n.to, kind="stable").tolist()
        assert start.tolist() == np.r_[0, np.cumsum(np.bincount(n.to, minlength=n.size))].tolist()


def test_arcs_by_target_need_little_memory():
    """An index of all arcs in 8 bytes each takes three times the result and more."""
    import tracemalloc

    m = 1 << 22
    n = arrays.Csr(np.arange(2), np.array([0, m, m]), np.random.default_rng(0).integers(0, 2, m).astype(np.int32))
    monkey, arrays.BLOCK = arrays.BLOCK, 1 << 16
    try:
        tracemalloc.start()
        arrays.by_target(n)
        assert tracemalloc.get_traced_memory()[1] < 6 * m
    finally:
        tracemalloc.stop()
        arrays.BLOCK = monkey


def test_compact_search_equals_joins(spark):
    draw = random.Random(13)
    for k in range(4):
        g = made(spark, random_edges(draw), bool(k % 2))
        root = g.edges.first()[0]
        assert rows(traversal.bfs(g, root, engine="compact")) == rows(traversal.bfs(g, root, engine="kernel"))
    assert rows(traversal.bfs(g, root, engine="compact", max_levels=1)) == rows(traversal.bfs(g, root, engine="kernel", max_levels=1))


def test_flow_queries_search_in_one_task(spark, unlimited, monkeypatch):
    """A search by joins writes a table a level, some hundred for a long way."""
    import arcweave.queries as queries

    g = made(spark, [(v, v + 1, 2.0, v) for v in range(60)])
    monkeypatch.setattr(queries.samples, "part_next", lambda *a: g)
    made_tables = []
    monkeypatch.setattr(traversal, "materialize", lambda df, name="table": made_tables.append(name) or df)
    found = queries.QUERIES["max_flow_preflow"](spark, "")
    assert not made_tables and rows(found, "src", "flow")[0] == (0, 2.0) and found.count() == 60


@pytest.mark.parametrize("method", ["edmonds_karp", "dinitz"])
def test_flow_queries_have_no_limit_of_edges(spark, method, unlimited, monkeypatch):
    """The whole query, with the search for its target."""
    import arcweave.queries as queries

    g = made(spark, [(v, v + k, 4.0 - k, 9 * v + k) for v in range(20) for k in (1, 2) if v + k <= 20])
    monkeypatch.setattr(queries.samples, "part_next", lambda *a: g)
    found = queries.QUERIES[f"max_flow_{method}"](spark, "")
    assert found.count() == 39 and rows(flow.flow_report(found, 0, 20)) == [(5.0, 0, 0)]
