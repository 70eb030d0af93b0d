import gzip

import pytest
from graphs import COMP8, MEET6, SPLIT4, TWOTRI, WALK7, graph, made, mapping, rows

from arcweave.operators import paths, traversal
from arcweave.sources import catalog, edges


def test_reader_rules(spark, tmp_path):
    text = "# comment\n1\t2\t3.5\n\n1 2 4.5\n  \n2 3\n 4   5  1.5  ignored\n"
    (tmp_path / "plain.txt").write_text(text)
    with gzip.open(tmp_path / "packed.txt.gz", "wt") as f:
        f.write(text)
    from arcweave.graph import Graph

    for name in ("plain.txt", "packed.txt.gz"):
        g = Graph.from_edges(edges.read_edges(spark, str(tmp_path / name)))
        assert rows(g.edges, "src", "dst", "weight") == [(1, 2, 4.5), (2, 3, 0.0), (4, 5, 1.5)]
        assert rows(g.stats()) == [(5, 3)]
        assert [v for v, _ in sorted(mapping(g.vertices, "id", "ord").items(), key=lambda x: x[1])] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("line", ["-1 2", "1", "1,2,3", " # x", "1 4294967296"])
def test_reader_errors(spark, tmp_path, line):
    (tmp_path / "bad.txt").write_text(f"1 2\n{line}\n")
    with pytest.raises(Exception, match="not an edge"):
        edges.read_edges(spark, str(tmp_path / "bad.txt")).collect()
    assert rows(edges.read_edges(spark, str(tmp_path / "bad.txt"), on_error="skip"), "src", "dst") == [(1, 2)]


def test_other_formats(spark, tmp_path):
    (tmp_path / "x.gr").write_text("c road\np sp 3 2\na 1 2 10\na 2 3 5\n")
    assert rows(edges.read(spark, str(tmp_path / "x.gr"), "dimacs"), "src", "dst", "weight") == [(1, 2, 10.0), (2, 3, 5.0)]
    (tmp_path / "x.csv").write_text("6,2,4,1289241911\n6,5,-2,1289241941\n")
    assert rows(edges.read(spark, str(tmp_path / "x.csv"), "ratings"), "src", "dst", "weight") == [(6, 2, 4.0), (6, 5, -2.0)]
    (tmp_path / "x.tsv").write_text("1\t2\t0.5\n")
    assert rows(edges.read(spark, str(tmp_path / "x.tsv"), "tab"), "src", "dst", "weight") == [(1, 2, 0.5)]
    out = str(tmp_path / "out")
    edges.write_edges(edges.read(spark, str(tmp_path / "x.gr"), "dimacs"), out)
    assert rows(edges.read_edges(spark, out), "src", "dst", "weight") == [(1, 2, 10.0), (2, 3, 5.0)]


def test_catalog(spark, tmp_path):
    names = [c.split()[0] for c in catalog.DATASETS.split(", ")]
    lines = [",".join(names), "a,5,,1,1,txt,,,,,,0,0,0,1,1,4", "b,,,0,0,txt,,,,,,1,0,0,0,,"]
    (tmp_path / "c.csv").write_text("\n".join(lines))
    progs = catalog.programs(spark, [("walk", "walk", "connectivity", [0], [0]), ("path", "path", "shortest", [1], [0, 1])])
    runs = catalog.plan_runs(catalog.read_catalog(spark, str(tmp_path / "c.csv")), progs)
    assert sorted(map(tuple, runs.collect()), key=str) == [("a", "path", "a.txt.gz", 1, 4), ("b", "walk", "b.txt.gz", None, None)]


def test_model(spark):
    g = made(spark, [(1, 2, 1.0, 0), (2, 1, 5.0, 1), (1, 2, 3.0, 2), (3, 3, 1.0, 3)])
    assert rows(g.edges, "src", "dst", "weight", "ord") == [(1, 2, 3.0, 0), (2, 1, 5.0, 1), (3, 3, 1.0, 3)]
    assert mapping(g.degrees()) == {1: 2, 2: 2, 3: 2}
    assert mapping(g.degrees("out")) == {1: 1, 2: 1, 3: 1}
    u = g.undirected()
    assert rows(u.edges, "src", "dst", "weight") == [(1, 2, 5.0), (3, 3, 1.0)]
    assert mapping(u.degrees()) == {1: 1, 2: 1, 3: 2}
    assert rows(g.reverse().edges, "src", "dst") == [(1, 2), (2, 1), (3, 3)]
    with pytest.raises(ValueError, match="vertex 9"):
        g.require(1, 9)


@pytest.mark.parametrize("engine", ["kernel", "relational"])
def test_bfs(spark, engine):
    g = graph(spark, WALK7)
    for parent in ("id", "queue"):
        found = traversal.bfs(g, 0, parent, engine=engine)
        assert mapping(found, "id", "level") == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3}
        assert mapping(found, "id", "parent") == {0: None, 1: 0, 2: 0, 3: 1, 4: 3}
    with pytest.raises(ValueError):
        traversal.bfs(g, 99)


def test_dfs(spark):
    found = traversal.dfs(graph(spark, WALK7), 0)
    assert [r["id"] for r in found.orderBy("visit_order").collect()] == [0, 2, 3, 4, 1]
    assert mapping(found, "id", "tree_parent") == {0: None, 2: 0, 3: 2, 4: 3, 1: 2}
    assert mapping(found, "id", "last_in_neighbor") == {0: None, 1: 2, 2: 4, 3: 1, 4: 3}


@pytest.mark.parametrize("engine", ["kernel", "relational"])
def test_shortest_paths(spark, engine):
    g = graph(spark, WALK7)
    found = paths.sssp(g, 0, engine=engine)
    assert mapping(found, "id", "distance") == {0: 0, 1: 3, 2: 1, 3: 8, 4: 11}
    assert mapping(found, "id", "parent") == {0: None, 1: 2, 2: 0, 3: 1, 4: 3}
    assert mapping(paths.sssp(g, 0, engine=engine, self_parent=True), "id", "parent")[0] == 0
    assert paths.st_cost(g, 0, 6, engine=engine).first()[0] is None
    for method in ("uni", "bi", "astar"):
        path = paths.st_path(graph(spark, MEET6), 1, 6, method, engine=engine)
        assert rows(path, "step", "src", "dst", "distance") == [(0, 1, 2, 3.0), (1, 2, 3, 6.5), (2, 3, 6, 9.5)]
        assert paths.st_path(graph(spark, SPLIT4), 1, 4, method, engine=engine).count() == 0
        assert paths.st_cost(graph(spark, SPLIT4), 2, 2, method, engine=engine).first()[0] == 0.0
    flat = graph(spark, "1>2 2>3 3>1 3>4")
    assert mapping(paths.sssp(flat, 1, engine=engine), "id", "parent") == {1: None, 2: 1, 3: 2, 4: 3}
    assert rows(paths.st_path(flat, 1, 4, engine=engine), "src", "dst") == [(1, 2), (2, 3), (3, 4)]
    with pytest.raises(ValueError, match="negative"):
        paths.sssp(graph(spark, "1>2:1"), 1, weight="-weight")


def test_connectivity(spark):
    g = graph(spark, TWOTRI)
    for engine in ("kernel", "relational"):
        assert rows(traversal.bridges(g, engine), "src", "dst") == [(3, 4), (6, 7)]
    assert rows(traversal.articulation_points(g)) == [(3,), (4,), (6,)]
    assert mapping(traversal.two_edge_components(g)) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7}
    blocks = traversal.biconnected_components(g)
    assert sorted(r["count"] for r in blocks.groupBy("block").count().collect()) == [1, 1, 3, 3]
    assert mapping(traversal.connected_components(graph(spark, SPLIT4))) == {1: 1, 2: 1, 3: 3, 4: 3}
    assert mapping(traversal.strongly_connected_components(graph(spark, WALK7))) == {0: 0, 1: 4, 2: 4, 3: 4, 4: 4, 5: 5, 6: 6}
    assert rows(traversal.is_bipartite(graph(spark, COMP8))) == [(1, False)]
    assert mapping(traversal.bipartition(graph(spark, "1-2 2-3 3-4 4-1")), "id", "side") == {1: 0, 2: 1, 3: 0, 4: 1}


def test_guided_search_with_inconsistent_bounds(spark):
    """A vertex that was closed opens again when a shorter way to it is found: 0-2-1-3 costs 7, 0-1-3 costs 9."""
    g = made(spark, [(0, 1, 4.0, 0), (0, 2, 1.0, 1), (2, 1, 1.0, 2), (1, 3, 5.0, 3)])
    bounds = spark.createDataFrame([(2, 6.0)], "id long, bound double")
    path = paths.st_path(g, 0, 3, "astar", heuristic=bounds).orderBy("step").collect()
    assert [(r["src"], r["dst"]) for r in path] == [(0, 2), (2, 1), (1, 3)] and path[-1]["distance"] == 7.0


def test_edges_without_order_are_ranked(spark):
    from arcweave.graph import Graph

    given = [(5, 1, 2.0), (1, 2, 7.0), (1, 2, 3.0), (5, 1, 1.0)]
    for parts in (1, 3):
        g = Graph.from_edges(spark.createDataFrame(given, "src long, dst long, weight double").repartition(parts))
        assert rows(g.edges, "src", "dst", "weight", "ord") == [(1, 2, 7.0, 0), (5, 1, 2.0, 1)]
