import itertools
import random

import pytest
from graphs import BIPARTITE, COMP8, FLOWS, LETTERS, graph, made, mapping, random_edges, rows

from arcweave.kernels import coloring as ck
from arcweave.kernels import flow as fk
from arcweave.kernels import search as sk
from arcweave.operators import coloring, flow, matching, paths, traversal


def test_greedy_goldens(spark):
    g = graph(spark, COMP8)
    assert mapping(coloring.color(g, "greedy")) == {2: 0, 1: 1, 4: 1, 3: 2, 5: 0, 6: 2, 8: 0, 7: 1}
    assert mapping(coloring.color(g, "welsh_powell")) == {4: 0, 3: 1, 5: 2, 6: 1, 2: 2, 7: 0, 1: 0, 8: 2}


METHODS = ["greedy", "welsh_powell", "sets", "iterated", "dsatur", "dsatur_heap", "dsatur_recompute", "rlf", "anneal", "anneal_partial", "tabu", "ants", "exact"]


@pytest.mark.parametrize("method", METHODS)
def test_colorings_are_proper(spark, method):
    g = graph(spark, COMP8)
    found = coloring.color(g, method)
    used, contiguous, conflicts, missing = rows(coloring.coloring_report(g, found))[0]
    assert (contiguous, conflicts, missing) == (True, 0, 0) and 3 <= used <= 4
    assert rows(coloring.clique_bound(g)) == [(3,)]
    assert rows(coloring.coloring_report(g, coloring.color_by_blocks(g)), "conflicts", "uncolored") == [(0, 0)]


def test_coloring_kernels_on_random_graphs():
    draw = random.Random(7)
    for _ in range(60):
        g = {v: set() for v in range(draw.randint(1, 9))}
        for u, v in itertools.combinations(g, 2):
            if draw.random() < 0.4:
                g[u].add(v)
                g[v].add(u)
        rank = {v: k for k, v in enumerate(g)}
        best = max(ck.exact(g, rank).values()) + 1
        assert best == next(k for k in range(1, 10) if any(all(c[u] != c[v] for u in g for v in g[u]) for c in itertools.product(range(k), repeat=len(g)))) if len(g) <= 6 else best
        assert ck.dsatur_scan(g, rank) == ck.dsatur_heap(g, rank) == ck.dsatur_heap(g, rank, False)
        for solve in (ck.dsatur_heap, ck.rlf, ck.iterated, lambda a, b: ck.anneal(a, b, steps=200), lambda a, b: ck.anneal(a, b, steps=200, partial=True), lambda a, b: ck.tabu(a, b, steps=50), lambda a, b: ck.ants(a, b, rounds=2)):
            c = solve(g, rank)
            assert set(c) == set(g) and not ck.conflicts(g, c) and max(c.values()) + 1 >= best


def test_greedy_rounds_equal_sequential(spark):
    draw = random.Random(3)
    for _ in range(3):
        edges = random_edges(draw)
        g = made(spark, edges, False)
        order = [v for v, _ in sorted(mapping(g.vertices, "id", "ord").items(), key=lambda x: x[1])]
        n = {v: set() for v in order}
        for u, v, _, _ in edges:
            if u != v:
                n[u].add(v)
                n[v].add(u)
        assert mapping(coloring.color(g, "greedy")) == ck.greedy(n, order)


def test_independent_sets(spark):
    g = graph(spark, COMP8)
    arcs = {tuple(r) for r in g.arcs().select("src", "dst").collect()}
    for seed in range(3):
        s = {r[0] for r in coloring.maximal_independent_set(g, 3, seed).collect()}
        assert 3 in s and not any((u, v) in arcs for u in s for v in s)
        assert all(v in s or any((v, u) in arcs for u in s) for v in range(1, 9))
        t = {r[0] for r in flow.sampled_independent_set(g, seed).collect()}
        assert not any((u, v) in arcs for u in t for v in t)


def test_dominated_and_universal(spark):
    g = graph(spark, "1-2 2-3 3-4")
    assert mapping(coloring.dominated_vertices(g)) == {1: 3, 4: 2}
    assert rows(coloring.universal_vertices(graph(spark, "1-2 1-3"))) == [(1,)]


@pytest.mark.parametrize("name", FLOWS)
def test_flows(spark, name):
    text, value, side = FLOWS[name]
    g = graph(spark, text)
    for method, engine in (("ford_fulkerson", "kernel"), ("edmonds_karp", "kernel"), ("dinitz", "kernel"), ("preflow", "kernel")) + ((("", "relational"),) if name in ("flow4", "flow4bad") else ()):
        found = flow.max_flow(g, 0, 1, method, engine)
        assert rows(flow.flow_report(found, 0, 1)) == [(float(value), 0, 0)], (method, engine)
    cut = flow.min_st_cut(g, 0, 1)
    assert flow.cut_value(g, cut).first()["forward"] == value
    assert flow.flow_across(found, cut).first()[0] == value
    if side:
        assert {v for v, s in mapping(cut).items() if not s} == {LETTERS[c] for c in side}


def test_random_flows_agree():
    draw = random.Random(1)
    for _ in range(150):
        arcs = list({(u, v): (u, v, w) for u, v, w, _ in random_edges(draw)}.values())
        s, t = 0, 1
        values = []
        for solve in (fk.edmonds_karp, fk.dinitz, fk.preflow):
            n = fk.Network(arcs)
            for v in (s, t):
                n.out.setdefault(v, [])
            solve(n, s, t)
            flows = n.flows()
            assert all(0 <= f <= c for f, (_, _, c) in zip(flows, arcs, strict=True))
            values.append(sum(f for f, (u, _, _) in zip(flows, arcs, strict=True) if u == s) - sum(f for f, (_, v, _) in zip(flows, arcs, strict=True) if v == s))
            side = fk.reachable(n, s)
            assert t not in side
            assert abs(sum(c for u, v, c in arcs if u in side and v not in side) - values[-1]) < 1e-9
        assert max(values) - min(values) < 1e-9


def test_cuts(spark):
    g = graph(spark, "1-2:3 2-3:3 3-1:3 3-4:1 4-5:3 5-6:3 6-4:3")
    for method, trials in (("karger", 40), ("karger_stein", 5)):
        found = flow.min_cut(g, method, trials)
        assert {r["value"] for r in found.collect()} == {1.0}
        assert {v for v, s in mapping(found, "id", "side").items() if not s} == {1, 2, 3}
    assert {r["value"] for r in flow.min_cut(graph(spark, "1-2:1 3-4:1"), "karger", 5).collect()} == {0.0}
    cut = flow.max_cut_random(g, flow.trials_for_cut(7))
    assert cut.first()["value"] >= 4


def test_bipartite(spark):
    g = matching.oriented(graph(spark, BIPARTITE))
    for method in ("hopcroft_karp", "flow"):
        assert rows(matching.matching_report(g, matching.bipartite_matching(g, method))) == [(3, 0, 0)]
    with pytest.raises(ValueError, match="bipartite"):
        matching.oriented(graph(spark, COMP8))


def test_assignment(spark):
    draw = random.Random(5)
    for n, m in ((3, 3), (3, 4), (4, 3)):
        cost = {(i, j): float(draw.randint(0, 9)) for i in range(n) for j in range(m)}
        g = made(spark, [(i, j, w, k) for k, ((i, j), w) in enumerate(cost.items())])
        for sense, pick in (("min", min), ("max", max)):
            k = min(n, m)
            best = pick(sum(cost[a, b] if n <= m else cost[b, a] for a, b in zip(range(k), p, strict=True)) for p in itertools.permutations(range(max(n, m)), k))
            found, labels = matching.assignment(g, sense), matching.assignment_labels(g, sense)
            total, certified, broken = rows(matching.certificate_report(g, found, labels, sense))[0]
            assert total == best and abs(certified - best) < 1e-9 and not broken


def test_hopcroft_karp_is_largest():
    draw = random.Random(9)
    for _ in range(200):
        arcs = {u: [v for v in range(5) if draw.random() < 0.3] for u in range(5)}
        size = max(k for k in range(6) if any(all(v in arcs[u] for u, v in zip(us, vs, strict=True)) for us in itertools.combinations(range(5), k) for vs in itertools.permutations(range(5), k)))
        found = fk.hopcroft_karp(arcs)
        assert len(found) == len(set(found.values())) == size and all(v in arcs[u] for u, v in found.items())


def test_search_kernels_on_random_graphs():
    draw = random.Random(2)
    for _ in range(300):
        edges = list({(u, v): (u, v, w, k) for u, v, w, k in random_edges(draw)}.values())
        columns = list(zip(*edges, strict=True))
        arcs = sk.adjacency(*columns)
        into = sk.adjacency(columns[1], columns[0], columns[2], columns[3])
        s, t = edges[0][0], draw.choice(edges)[1]
        distance, parent = sk.dijkstra(arcs, s)
        inf = float("inf")
        d = {v: 0.0 if v == s else inf for e in edges for v in e[:2]}
        for _ in d:
            for u, v, w, _ in edges:
                d[v] = min(d[v], d[u] + w)
        assert distance == {v: x for v, x in d.items() if x < inf}
        both = sk.two_sided(arcs, into, s, t)
        assert (both is None) == (t not in distance)
        if both is not None:
            assert sum(w for _, _, w in both) == distance[t]
            assert sum(w for _, _, w in sk.path_arcs(arcs, parent, t)) == distance[t]
        # bridges and articulation points by removal
        u_edges = sorted({(min(e[:2]), max(e[:2])) for e in edges if e[0] != e[1]})
        if not u_edges:
            continue
        cutting, bridges, blocks = sk.lowpoints(sk.adjacency([a for a, _ in u_edges], [b for _, b in u_edges], [0.0] * len(u_edges), range(len(u_edges)), True))

        def parts(es, vs):
            name = {v: v for v in vs}
            for _ in vs:
                for a, b in es:
                    name[a] = name[b] = min(name[a], name[b])
            return len(set(name.values()))

        vs = {v for e in u_edges for v in e}
        base = parts(u_edges, vs)
        assert sorted(bridges) == [e for e in u_edges if parts([x for x in u_edges if x != e], vs) > base]
        assert cutting == {v for v in vs if parts([e for e in u_edges if v not in e], vs - {v}) > base}
        assert sorted((min(e), max(e)) for b in blocks for e in b) == u_edges


def test_relational_forms_equal_kernels(spark):
    draw = random.Random(11)
    for _ in range(3):
        g = made(spark, random_edges(draw))
        root = g.edges.orderBy("ord").first()["src"]
        for parent in ("id", "queue"):
            assert rows(traversal.bfs(g, root, parent, engine="kernel")) == rows(traversal.bfs(g, root, parent, engine="relational"))
        a, b = paths.sssp(g, root, engine="kernel"), paths.sssp(g, root, engine="relational")
        assert rows(a, "id", "distance") == rows(b, "id", "distance")
        assert rows(traversal.bridges(g)) == rows(traversal.bridges(g, "relational"))
