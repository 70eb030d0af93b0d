"""Registered queries of the graph operators, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions import adjacency, codes
from arcweave.operators import coloring, flow, matching, paths, traversal
from arcweave.plans import samples
from arcweave.plans.lineage import materialize, shared_folder
from arcweave.sources import catalog, edges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SEQ, NEXT, FIRST = samples.PART_SEQ_SQL, samples.part_next_sql(), samples.part_next_sql(1)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _target(g, source: int = 0, engine: str = "auto") -> int:  # noqa: ANN001
    """The vertex farthest from the source in arcs, ties to the larger id."""
    return traversal.bfs(g, source, engine=engine).orderBy(F.desc("level"), F.desc("id")).first()[0]


# --- model -----------------------------------------------------------------


@query(f"WITH {SEQ}, v AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges) SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM edges) AS m")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return samples.part_seq(spark, d).stats()


@query(f"WITH {SEQ} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id")
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return samples.part_seq(spark, d).degrees()


@query(f"WITH {SEQ}, {samples.BOTH_SQL} SELECT src AS id, count(*) AS degree FROM arcs GROUP BY src")
def graph_degrees_undirected(spark: SparkSession, d: str) -> DataFrame:
    return samples.part_seq(spark, d, directed=False).degrees()


@query(f"WITH {SEQ}, v AS (SELECT src AS id, min(src * 4294967296 + dst) * 2 AS o FROM edges GROUP BY 1 UNION ALL SELECT dst, min(src * 4294967296 + dst) * 2 + 1 FROM edges GROUP BY 1) SELECT id, CAST(min(o) AS BIGINT) AS ord FROM v GROUP BY id")
def graph_vertices(spark: SparkSession, d: str) -> DataFrame:
    return samples.part_seq(spark, d).vertices


@query(f"WITH {SEQ} SELECT src AS id, dst AS neighbor, weight FROM edges")
def neighbors_out(spark: SparkSession, d: str) -> DataFrame:
    g = samples.part_seq(spark, d)
    return g.neighbors(g.vertices)


@query(f"WITH {SEQ} SELECT dst AS id, src AS neighbor, weight FROM edges")
def neighbors_in(spark: SparkSession, d: str) -> DataFrame:
    g = samples.part_seq(spark, d).reverse()
    return g.neighbors(g.vertices)


@query(f"WITH {SEQ}, {samples.BOTH_SQL} SELECT src AS id, dst AS neighbor FROM arcs")
def neighbors_undirected(spark: SparkSession, d: str) -> DataFrame:
    g = samples.part_seq(spark, d, directed=False)
    return g.neighbors(g.vertices).select("id", "neighbor")


@query(f"WITH {SEQ} SELECT src, dst, weight FROM edges")
def edge_weights(spark: SparkSession, d: str) -> DataFrame:
    g = samples.part_seq(spark, d)
    return g.edge_weight(g.edges)


@query(f"WITH {SEQ}, {samples.BOTH_SQL}, deg AS (SELECT src AS id, count(*) AS degree FROM arcs GROUP BY src) SELECT max(degree) AS degree FROM deg")
def max_degree(spark: SparkSession, d: str) -> DataFrame:
    return samples.part_seq(spark, d, directed=False).max_degree_vertex().select("degree")


# --- traversal -------------------------------------------------------------

BFS_SQL = """, bfs(id, level) USING KEY (id) AS (
    SELECT CAST(0 AS BIGINT), 0 UNION
    SELECT e.dst, min(b.level) + 1 FROM bfs b JOIN {arcs} e ON b.id = e.src WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs r WHERE r.id = e.dst) GROUP BY e.dst
) SELECT b.id, b.level, (SELECT min(a.src) FROM {arcs} a JOIN bfs p ON p.id = a.src WHERE a.dst = b.id AND p.level = b.level - 1) AS parent FROM bfs b"""


@query(f"WITH RECURSIVE {SEQ}{BFS_SQL.format(arcs='edges')}")
def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    return traversal.bfs(samples.part_seq(spark, d))


@query(f"WITH RECURSIVE {SEQ}{BFS_SQL.format(arcs='edges')}")
def bfs_relational(spark: SparkSession, d: str) -> DataFrame:
    return traversal.bfs(samples.part_seq(spark, d), engine="relational")


@query(f"WITH RECURSIVE {SEQ}, {samples.BOTH_SQL}{BFS_SQL.format(arcs='arcs')}")
def bfs_undirected(spark: SparkSession, d: str) -> DataFrame:
    return traversal.bfs(samples.part_seq(spark, d, directed=False))


@query(f"WITH RECURSIVE {NEXT}{BFS_SQL.format(arcs='edges')}")
def bfs_deep(spark: SparkSession, d: str) -> DataFrame:
    return traversal.bfs(samples.part_next(spark, d))


# place: a vertex's place in its level, by its parent's place and then by id, as arcs are in the order of their ends
QUEUE_SQL = """, bfs(id, level, place, parent) USING KEY (id) AS (
    SELECT CAST(0 AS BIGINT), 0, CAST(1 AS BIGINT), CAST(NULL AS BIGINT) UNION
    SELECT id, level, row_number() OVER (ORDER BY up, id), parent FROM (
        SELECT e.dst AS id, max(b.level) + 1 AS level, min(b.place) AS up, arg_min(b.id, b.place) AS parent
        FROM bfs b JOIN edges e ON b.id = e.src WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs r WHERE r.id = e.dst) GROUP BY e.dst)
) SELECT id, level, parent FROM bfs"""


@query(f"WITH RECURSIVE {SEQ}{QUEUE_SQL}")
def bfs_queue_order(spark: SparkSession, d: str) -> DataFrame:
    return traversal.bfs(samples.part_seq(spark, d), parent="queue")


@query()
def dfs_order(spark: SparkSession, d: str) -> DataFrame:
    return traversal.dfs(samples.part_seq(spark, d))


# one row a step: the stack of (vertex, pushed by), its top last, and the vertices visited so far
DFS_SQL = """, heads AS (SELECT src, list({id: dst, up: src} ORDER BY dst) AS next FROM edges GROUP BY src
), walk(step, id, up, fresh, stack, seen) AS (
    SELECT 0, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), true, (SELECT next FROM heads WHERE src = 0), [CAST(0 AS BIGINT)] UNION ALL
    SELECT step + 1, top.id, top.up, fresh, CASE WHEN fresh THEN list_concat(rest, coalesce(next, [])) ELSE rest END, CASE WHEN fresh THEN list_append(seen, top.id) ELSE seen END
    FROM (SELECT step, stack[-1] AS top, stack[:-2] AS rest, seen, NOT list_contains(seen, stack[-1].id) AS fresh FROM walk WHERE len(stack) > 0) LEFT JOIN heads ON src = top.id
), visits AS (SELECT id, row_number() OVER (ORDER BY step) - 1 AS k, up FROM walk WHERE fresh)
SELECT v.id, CAST(v.k AS INTEGER) AS visit_order, v.up AS tree_parent, (SELECT arg_max(e.src, u.k) FROM edges e JOIN visits u ON u.id = e.src WHERE e.dst = v.id) AS last_in_neighbor FROM visits v"""


@query(f"WITH RECURSIVE {NEXT}{DFS_SQL}")
def dfs_order_sparse(spark: SparkSession, d: str) -> DataFrame:
    return traversal.dfs(samples.part_next(spark, d))


@query(f"WITH RECURSIVE {SEQ}{BFS_SQL.format(arcs='edges').split(' SELECT b.id, b.level')[0]} SELECT count(*) AS reached FROM bfs")
def dfs_reached(spark: SparkSession, d: str) -> DataFrame:
    return traversal.dfs(samples.part_seq(spark, d)).agg(F.count(F.lit(1)).alias("reached"))


CC_SQL = """, cc(id, component) USING KEY (id) AS (
    SELECT src, src FROM (SELECT DISTINCT src FROM arcs) UNION
    SELECT a.dst, min(c.component) FROM cc c JOIN arcs a ON c.id = a.src JOIN recurring.cc r ON r.id = a.dst WHERE c.component < r.component GROUP BY a.dst
) """


@query(f"WITH RECURSIVE {NEXT}, {samples.BOTH_SQL}{CC_SQL} SELECT id, component FROM cc")
def components(spark: SparkSession, d: str) -> DataFrame:
    return traversal.connected_components(samples.part_next(spark, d))


REACH_SQL = ", reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON r.b = e.src)"


@query(f"WITH RECURSIVE {NEXT}{REACH_SQL}, v AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges) SELECT v.id, greatest(v.id, coalesce(max(r.b), v.id)) AS component FROM v LEFT JOIN reach r ON r.a = v.id AND EXISTS (SELECT 1 FROM reach q WHERE q.a = r.b AND q.b = r.a) GROUP BY v.id")
def strong_components(spark: SparkSession, d: str) -> DataFrame:
    return traversal.strongly_connected_components(samples.part_next(spark, d))


@query(f"""WITH RECURSIVE {FIRST}, {samples.BOTH_SQL}{CC_SQL}, level(id, level) USING KEY (id) AS (
    SELECT id, 0 FROM cc WHERE id = component UNION
    SELECT a.dst, min(l.level) + 1 FROM level l JOIN arcs a ON l.id = a.src WHERE NOT EXISTS (SELECT 1 FROM recurring.level r WHERE r.id = a.dst) GROUP BY a.dst
), odd AS (SELECT DISTINCT component FROM arcs JOIN level a ON a.id = src JOIN level b ON b.id = dst JOIN cc ON cc.id = src WHERE a.level % 2 = b.level % 2)
SELECT id, CASE WHEN component NOT IN (SELECT component FROM odd) THEN CAST(level % 2 AS INTEGER) END AS side, component, component NOT IN (SELECT component FROM odd) AS bipartite FROM level JOIN cc USING (id)""")
def bipartite_sides(spark: SparkSession, d: str) -> DataFrame:
    return traversal.bipartition(samples.part_next(spark, d, k=1))


@query("SELECT CAST(0 AS BIGINT) AS odd")
def bipartite_test(spark: SparkSession, d: str) -> DataFrame:
    return traversal.is_bipartite(samples.part_supplier(spark, d)).agg(F.count_if(~F.col("bipartite")).alias("odd"))


# Blocks in SQL: a breadth-first forest; every other edge (x, y) joins, at each ancestor of an end, the two sides it leads to,
# a side being the child towards the end, or the ancestor itself for all that is above it. Tree edges go by their lower end.
BLOCK_SQL = f""", {samples.BOTH_SQL}{CC_SQL}, level(id, level) USING KEY (id) AS (
    SELECT id, 0 FROM cc WHERE id = component UNION
    SELECT a.dst, min(l.level) + 1 FROM level l JOIN arcs a ON l.id = a.src WHERE NOT EXISTS (SELECT 1 FROM recurring.level r WHERE r.id = a.dst) GROUP BY a.dst
), tree AS (SELECT a.dst AS id, min(a.src) AS parent FROM arcs a JOIN level p ON p.id = a.src JOIN level c ON c.id = a.dst WHERE c.level = p.level + 1 GROUP BY a.dst
), above(id, top, side) AS (SELECT id, parent, id FROM tree UNION ALL SELECT a.id, t.parent, a.top FROM above a JOIN tree t ON t.id = a.top
), pairs AS (SELECT src, dst FROM arcs WHERE src < dst
), other AS (SELECT src, dst FROM pairs WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE (t.id = src AND t.parent = dst) OR (t.id = dst AND t.parent = src))
), sides AS (
    SELECT coalesce(p.side, q.top) AS a, coalesce(q.side, p.top) AS b
    FROM (SELECT src, dst, top, side FROM other JOIN above ON id = src) p FULL JOIN (SELECT src, dst, top, side FROM other JOIN above ON id = dst) q ON p.src = q.src AND p.dst = q.dst AND p.top = q.top
), links AS (SELECT a, b FROM sides WHERE a <> b UNION SELECT b, a FROM sides WHERE a <> b
), block(id, name) USING KEY (id) AS (
    SELECT id, id FROM tree UNION
    SELECT l.b, min(k.name) FROM block k JOIN links l ON k.id = l.a JOIN recurring.block r ON r.id = l.b WHERE k.name < r.name GROUP BY l.b
), named AS (
    SELECT src, dst, k.name FROM other JOIN block k ON k.id = CASE WHEN EXISTS (SELECT 1 FROM tree t WHERE t.id = src) THEN src ELSE dst END UNION ALL
    SELECT least(t.id, parent), greatest(t.id, parent), name FROM tree t JOIN block k ON k.id = t.id
), cut AS (SELECT min(src) AS src, min(dst) AS dst FROM named GROUP BY name HAVING count(*) = 1)"""
BRIDGE_SQL = f"WITH RECURSIVE {FIRST}{BLOCK_SQL} SELECT src, dst FROM cut"


@query(BRIDGE_SQL)
def bridge_edges(spark: SparkSession, d: str) -> DataFrame:
    return traversal.bridges(samples.part_next(spark, d, k=1))


@query(BRIDGE_SQL.replace(FIRST, NEXT))
def bridge_edges_relational(spark: SparkSession, d: str) -> DataFrame:
    return traversal.bridges(samples.part_next(spark, d), engine="relational")


@query(f"WITH RECURSIVE {FIRST}{BLOCK_SQL}, ends AS (SELECT src AS id, name FROM named UNION SELECT dst, name FROM named) SELECT id FROM ends GROUP BY id HAVING count(*) > 1")
def articulation_vertices(spark: SparkSession, d: str) -> DataFrame:
    return traversal.articulation_points(samples.part_next(spark, d, k=1))


@query(f"WITH RECURSIVE {FIRST}{BLOCK_SQL} SELECT src, dst, min(src || '-' || dst) FILTER (WHERE place = 1) OVER (PARTITION BY name) AS block FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY src, dst) AS place FROM named)")
def biconnected_blocks(spark: SparkSession, d: str) -> DataFrame:
    return traversal.biconnected_components(samples.part_next(spark, d, k=1))


@query(f"WITH RECURSIVE {FIRST}{BLOCK_SQL}, kept AS (SELECT src, dst FROM pairs EXCEPT SELECT src, dst FROM cut), ways AS (SELECT src, dst FROM kept UNION SELECT dst, src FROM kept), part(id, component) USING KEY (id) AS (SELECT id, id FROM cc UNION SELECT w.dst, min(p.component) FROM part p JOIN ways w ON p.id = w.src JOIN recurring.part r ON r.id = w.dst WHERE p.component < r.component GROUP BY w.dst) SELECT id, component FROM part")
def two_edge_components(spark: SparkSession, d: str) -> DataFrame:
    return traversal.two_edge_components(samples.part_next(spark, d, k=1))


# --- paths -----------------------------------------------------------------

SSSP_SQL = """, sp(id, distance) USING KEY (id) AS (
    SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE) UNION
    SELECT e.dst, min(s.distance + e.weight) FROM sp s JOIN edges e ON s.id = e.src LEFT JOIN recurring.sp r ON r.id = e.dst WHERE r.distance IS NULL OR s.distance + e.weight < r.distance GROUP BY e.dst
) """
PARENT_SQL = "SELECT t.id, t.distance, (SELECT arg_min(e.src, struct_pack(d := p.distance, i := -e.src)) FROM edges e JOIN sp p ON p.id = e.src WHERE e.dst = t.id AND p.distance + e.weight = t.distance) AS parent FROM sp t"


@query(f"WITH RECURSIVE {SEQ}{SSSP_SQL}{PARENT_SQL}")
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    return paths.sssp(samples.part_seq(spark, d), 0)


@query(f"WITH RECURSIVE {SEQ}{SSSP_SQL}{PARENT_SQL}")
def shortest_paths_relational(spark: SparkSession, d: str) -> DataFrame:
    return paths.sssp(samples.part_seq(spark, d), 0, engine="relational")


@query(f"WITH RECURSIVE {NEXT}{SSSP_SQL} SELECT id, distance FROM sp")
def shortest_distances_deep(spark: SparkSession, d: str) -> DataFrame:
    return paths.sssp(samples.part_next(spark, d), 0, parents=False)


COST_SQL = f"WITH RECURSIVE {SEQ}{SSSP_SQL}, {BFS_SQL.format(arcs='edges').split(' SELECT b.id, b.level')[0].lstrip(', ')} SELECT distance AS cost FROM sp WHERE id = (SELECT id FROM bfs ORDER BY level DESC, id DESC LIMIT 1)"


@query(COST_SQL)
def path_cost(spark: SparkSession, d: str) -> DataFrame:
    g = samples.part_seq(spark, d)
    return paths.st_cost(g, 0, _target(g))


@query(COST_SQL)
def path_cost_two_sided(spark: SparkSession, d: str) -> DataFrame:
    g = samples.part_seq(spark, d)
    return paths.st_cost(g, 0, _target(g), "bi")


@query(COST_SQL)
def path_cost_two_sided_relational(spark: SparkSession, d: str) -> DataFrame:
    g = samples.part_seq(spark, d)
    return paths.st_cost(g, 0, _target(g), "bi", engine="relational")


@query(COST_SQL)
def path_cost_guided(spark: SparkSession, d: str) -> DataFrame:
    g = samples.part_seq(spark, d)
    target = _target(g)
    # quantities are 1 or more, so the number of arcs still to go is a lower bound
    back = traversal.bfs(g.reverse(), target).select("id", F.col("level").cast("double").alias("bound"))
    return paths.st_path(g, 0, target, "astar", heuristic=back).agg(F.sum("cost").alias("cost"))


@query()
def path_arcs(spark: SparkSession, d: str) -> DataFrame:
    g = samples.part_seq(spark, d)
    return paths.st_path(g, 0, _target(g))


@query(f"WITH RECURSIVE {SEQ}{SSSP_SQL}, {BFS_SQL.format(arcs='edges').split(' SELECT b.id, b.level')[0].lstrip(', ')} SELECT max(distance) AS distance FROM sp WHERE id = (SELECT id FROM bfs ORDER BY level DESC, id DESC LIMIT 1)")
def path_running_distance(spark: SparkSession, d: str) -> DataFrame:
    g = samples.part_seq(spark, d)
    return paths.st_path(g, 0, _target(g), "bi").agg(F.max("distance").alias("distance"))


# --- coloring --------------------------------------------------------------

PROPER_SQL = f"WITH {NEXT}, v AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges) SELECT CAST(0 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS uncolored, true AS contiguous, count(*) AS vertices FROM v"


def _report(g, found: DataFrame) -> DataFrame:  # noqa: ANN001
    found = materialize(found, "coloring")
    return coloring.coloring_report(g, found).select("conflicts", "uncolored", "contiguous").crossJoin(found.agg(F.count(F.lit(1)).alias("vertices")))


def _coloring(method: str) -> None:
    def colors(spark: SparkSession, d: str) -> DataFrame:
        return coloring.color(samples.part_next(spark, d, directed=False), method)

    def proper(spark: SparkSession, d: str) -> DataFrame:
        g = samples.part_next(spark, d, directed=False)
        return _report(g, coloring.color(g, method))

    QUERIES[f"color_{method}"] = colors
    QUERIES[f"color_{method}_proper"] = proper
    SQL[f"color_{method}_proper"] = PROPER_SQL


# one vertex a step: most colors beside it, most uncolored neighbours, then order of appearance
SATURATION_SQL = f"""WITH RECURSIVE {NEXT}, {samples.BOTH_SQL}, seen AS (
    SELECT src AS id, min(src * 4294967296 + dst) * 2 AS ord FROM edges GROUP BY 1 UNION ALL SELECT dst, min(src * 4294967296 + dst) * 2 + 1 FROM edges GROUP BY 1
), first AS (SELECT id, min(ord) AS ord FROM seen GROUP BY id
), near AS (SELECT src, dst, ord FROM arcs JOIN first ON id = src
), colored(id, color) USING KEY (id) AS (
    (SELECT src, 0 FROM near GROUP BY src, ord ORDER BY count(*) DESC, ord LIMIT 1) UNION
    (SELECT id, (SELECT CAST(min(k) AS INTEGER) FROM range(100) t(k) WHERE NOT list_contains(used, k)) FROM (
        SELECT n.src AS id, n.ord, coalesce(list(DISTINCT r.color) FILTER (WHERE r.color IS NOT NULL), []) AS used, count(*) FILTER (WHERE r.color IS NULL) AS open
        FROM (SELECT 1 FROM colored LIMIT 1) JOIN near n ON true LEFT JOIN recurring.colored r ON r.id = n.dst WHERE NOT EXISTS (SELECT 1 FROM recurring.colored q WHERE q.id = n.src)
        GROUP BY n.src, n.ord ORDER BY len(used) DESC, open DESC, n.ord LIMIT 1))
) SELECT id, color FROM colored"""

# one vertex a step, in order, with the smallest color that no neighbour has
GREEDY_SQL = f"""WITH RECURSIVE {NEXT}, {samples.BOTH_SQL}, seen AS (
    SELECT src AS id, min(src * 4294967296 + dst) * 2 AS ord FROM edges GROUP BY 1 UNION ALL SELECT dst, min(src * 4294967296 + dst) * 2 + 1 FROM edges GROUP BY 1
), place AS (SELECT id, row_number() OVER (ORDER BY {{order}}) AS place FROM (SELECT id, min(ord) AS ord FROM seen GROUP BY id) JOIN (SELECT src AS id, count(*) AS degree FROM arcs GROUP BY 1) USING (id)
), near AS (SELECT place, id, list(dst) AS beside FROM place JOIN arcs ON src = id GROUP BY place, id
), colored(place, id, color) USING KEY (id) AS (
    SELECT place, id, 0 FROM place WHERE place = 1 UNION
    SELECT n.place, n.id, (SELECT CAST(min(k) AS INTEGER) FROM range(2000) t(k) WHERE NOT list_contains(s.used, k)) FROM (
        SELECT n.place, n.id, coalesce(list(r.color) FILTER (WHERE list_contains(n.beside, r.id)), []) AS used FROM colored c JOIN near n ON n.place = c.place + 1, recurring.colored r GROUP BY n.place, n.id) s JOIN near n ON n.id = s.id
) SELECT id, color FROM colored"""

for _method in ("greedy", "welsh_powell", "dsatur", "dsatur_heap", "dsatur_recompute", "rlf", "sets", "iterated", "anneal", "anneal_partial", "tabu"):
    _coloring(_method)
for _method in ("dsatur", "dsatur_heap", "dsatur_recompute"):
    SQL[f"color_{_method}"] = SATURATION_SQL
SQL["color_greedy"] = GREEDY_SQL.format(order="ord")
SQL["color_welsh_powell"] = GREEDY_SQL.format(order="degree DESC, ord")


@query("SELECT CAST(0 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS uncolored, true AS contiguous, count(*) AS vertices FROM nation")
def color_ants_proper(spark: SparkSession, d: str) -> DataFrame:
    g = samples.nation_trade(spark, d).undirected()
    return _report(g, coloring.color(g, "ants"))


@query("SELECT CAST(count(*) AS BIGINT) AS colors_used FROM nation")
def color_exact_nations(spark: SparkSession, d: str) -> DataFrame:
    g = samples.nation_trade(spark, d).undirected()
    return coloring.coloring_report(g, coloring.color(g, "exact")).select("colors_used")


@query(PROPER_SQL)
def color_blocks_proper(spark: SparkSession, d: str) -> DataFrame:
    g = samples.part_next(spark, d, directed=False)
    return _report(g, coloring.color_by_blocks(g))


@query(f"WITH {NEXT}, {samples.BOTH_SQL}, deg AS (SELECT src AS id, count(*) AS degree FROM arcs GROUP BY src), shared AS (SELECT a.src AS id, b.src AS by, count(*) AS n FROM arcs a JOIN arcs b ON a.dst = b.dst AND a.src <> b.src GROUP BY 1, 2) SELECT s.id, min(s.by) AS by FROM shared s JOIN deg d ON d.id = s.id AND d.degree = s.n WHERE NOT EXISTS (SELECT 1 FROM arcs x WHERE x.src = s.id AND x.dst = s.by) GROUP BY s.id")
def dominated_vertices(spark: SparkSession, d: str) -> DataFrame:
    return coloring.dominated_vertices(samples.part_next(spark, d, directed=False))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation")
def universal_vertices(spark: SparkSession, d: str) -> DataFrame:
    return coloring.universal_vertices(samples.nation_trade(spark, d))


CLIQUE_SQL = f"WITH {NEXT}, e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges), t AS (SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b), f AS (SELECT t.a FROM t JOIN e p ON p.a = t.c JOIN e q ON q.a = t.b AND q.b = p.b JOIN e r ON r.a = t.a AND r.b = p.b LIMIT 1) SELECT CASE WHEN EXISTS (SELECT 1 FROM f) THEN 4 WHEN EXISTS (SELECT 1 FROM t) THEN 3 ELSE 2 END AS clique"


@query(CLIQUE_SQL)
def clique_bound(spark: SparkSession, d: str) -> DataFrame:
    return coloring.clique_bound(samples.part_next(spark, d))


@query()
def independent_set(spark: SparkSession, d: str) -> DataFrame:
    return coloring.maximal_independent_set(samples.part_next(spark, d), 0)


@query("SELECT CAST(0 AS BIGINT) AS inside, CAST(0 AS BIGINT) AS uncovered")
def independent_set_check(spark: SparkSession, d: str) -> DataFrame:
    g = samples.part_next(spark, d, directed=False)
    chosen = materialize(coloring.maximal_independent_set(g, 0), "set")
    arcs = g.without_loops().arcs().select("src", "dst")
    from_set = arcs.join(chosen.withColumnRenamed("id", "src"), "src", "left_semi")
    inside = from_set.join(chosen.withColumnRenamed("id", "dst"), "dst", "left_semi").agg(F.count(F.lit(1)).alias("inside"))
    covered = chosen.union(from_set.select(F.col("dst").alias("id")))
    return inside.crossJoin(g.vertices.join(covered, "id", "left_anti").agg(F.count(F.lit(1)).alias("uncovered")))


# --- flow and cuts -----------------------------------------------------------


def _flow_query(method: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = samples.part_next(spark, d)
        # the flow takes the graph in one task, so its search may too; joins need a round a level, of which there may be hundreds
        return flow.max_flow(g, 0, _target(g, engine="compact"), method)

    QUERIES[f"max_flow_{method}"] = run


for _method in ("edmonds_karp", "dinitz", "preflow"):
    _flow_query(_method)


@query()
def max_flow_relational(spark: SparkSession, d: str) -> DataFrame:
    g = samples.part_next(spark, d)
    return flow.max_flow(g, 0, _target(g), "edmonds_karp", "relational")


@query("SELECT CAST(0 AS BIGINT) AS unbalanced, CAST(0 AS BIGINT) AS out_of_bounds, true AS cut_is_flow")
def flow_certificate(spark: SparkSession, d: str) -> DataFrame:
    """Conservation, bounds, and a cut of the flow's value: optimality of both."""
    g = samples.nation_trade(spark, d)
    found = materialize(flow.max_flow(g, 0, 24), "flow")
    cut = flow.cut_value(g, flow.min_st_cut(g, 0, 24))
    report = flow.flow_report(found, 0, 24).crossJoin(cut).crossJoin(flow.flow_across(found, flow.min_st_cut(g, 0, 24)))
    return report.select("unbalanced", "out_of_bounds", ((F.abs(F.col("value") - F.col("forward")) < 1e-6) & (F.abs(F.col("across") - F.col("value")) < 1e-6)).alias("cut_is_flow"))


@query()
def min_cut_sides(spark: SparkSession, d: str) -> DataFrame:
    return flow.min_st_cut(samples.nation_trade(spark, d), 0, 24)


@query(f"WITH {samples.NATION_TRADE_SQL}, s AS (SELECT src, dst, weight, CASE WHEN src % 2 = 0 THEN 0 ELSE 1 END AS a, CASE WHEN dst % 2 = 0 THEN 0 ELSE 1 END AS b FROM edges) SELECT coalesce(sum(weight) FILTER (WHERE a = 0 AND b = 1), 0.0) AS forward, coalesce(sum(weight) FILTER (WHERE a = 1 AND b = 0), 0.0) AS backward, coalesce(sum(weight) FILTER (WHERE a <> b), 0.0) AS total FROM s")
def cut_values(spark: SparkSession, d: str) -> DataFrame:
    g = samples.nation_trade(spark, d)
    return flow.cut_value(g, g.vertices.select("id", (F.col("id") % 2).cast("int").alias("side")))


@query(f"WITH {SEQ}, t AS (SELECT range AS seed FROM range(8)), c AS (SELECT seed, count(*) FILTER (WHERE (substr(md5(src || ':' || seed), 1, 1) < '8') <> (substr(md5(dst || ':' || seed), 1, 1) < '8')) AS value FROM edges, t GROUP BY seed), best AS (SELECT seed, value FROM c ORDER BY value DESC, seed LIMIT 1), v AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges) SELECT id, CASE WHEN substr(md5(id || ':' || seed), 1, 1) < '8' THEN 0 ELSE 1 END AS side, value FROM v, best")
def random_max_cut(spark: SparkSession, d: str) -> DataFrame:
    return flow.max_cut_random(samples.part_seq(spark, d))


@query(f"WITH {SEQ}, e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges), v AS (SELECT a AS id FROM e UNION SELECT b FROM e), n AS (SELECT least(1.0, (SELECT count(*) FROM v) / (2.0 * (SELECT count(*) FROM edges))) AS rate), k AS (SELECT id FROM v, n WHERE CAST('0x' || substr(md5(id || ':0'), 1, 8) AS BIGINT) < CAST(floor(rate * 4294967296) AS BIGINT)) SELECT id FROM k WHERE id NOT IN (SELECT b FROM e WHERE a IN (SELECT id FROM k) AND b IN (SELECT id FROM k))")
def random_independent_set(spark: SparkSession, d: str) -> DataFrame:
    return flow.sampled_independent_set(samples.part_seq(spark, d))


@query()
def global_min_cut(spark: SparkSession, d: str) -> DataFrame:
    return flow.min_cut(samples.nation_trade(spark, d), "karger", 60)


@query()
def global_min_cut_recursive(spark: SparkSession, d: str) -> DataFrame:
    return flow.min_cut(samples.nation_trade(spark, d), "karger_stein", 4)


# --- matching ----------------------------------------------------------------


def _matching_query(method: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = samples.part_supplier(spark, d)
        return matching.matching_report(g, materialize(matching.bipartite_matching(g, method), "matching"))

    QUERIES[f"matching_{method}"] = run
    # every supplier can be matched on these tables; parts are many times more
    SQL[f"matching_{method}"] = "SELECT count(DISTINCT l_suppkey) AS pairs, CAST(0 AS BIGINT) AS used_twice, CAST(0 AS BIGINT) AS not_an_edge FROM lineitem"


for _method in ("hopcroft_karp", "flow"):
    _matching_query(_method)


@query()
def assignment_pairs(spark: SparkSession, d: str) -> DataFrame:
    return matching.assignment(samples.nation_trade(spark, d))


def _certificate(sense: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = samples.nation_trade(spark, d)
        report = matching.certificate_report(g, matching.assignment(g, sense), matching.assignment_labels(g, sense), sense)
        return report.select((F.abs(F.col("cost") - F.col("labels")) < 1e-6).alias("tight"), "violations")

    QUERIES[f"assignment_{sense}_certificate"] = run
    SQL[f"assignment_{sense}_certificate"] = "SELECT true AS tight, CAST(0 AS BIGINT) AS violations"


for _sense in ("min", "max"):
    _certificate(_sense)


# --- compression ---------------------------------------------------------------


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    return samples.table(spark, d, "lineitem").select((F.col("l_partkey") + 1).alias("x")).distinct()


X_SQL = "x AS (SELECT DISTINCT l_partkey + 1 AS x FROM lineitem)"
MIN_BIN_SQL = "CASE WHEN {x} < (1 << {s}) - {z} THEN CASE WHEN {s} > 1 THEN lpad(bin({x}), CAST({s} - 1 AS INTEGER), '0') ELSE '' END ELSE lpad(bin({x} + (1 << {s}) - {z}), CAST({s} AS INTEGER), '0') END"


@query(f"WITH {X_SQL} SELECT x, repeat('0', length(bin(x)) - 1) || bin(x) AS gamma, repeat('0', length(bin(length(bin(x)))) - 1) || bin(length(bin(x))) || substr(bin(x), 2) AS delta FROM x")
def codes_elias(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(spark, d).select("x", codes.gamma(F.col("x")).alias("gamma"), codes.delta(F.col("x")).alias("delta"))


@query(f"WITH {X_SQL}, p AS (SELECT x, CAST(ceil(length(bin(x)) / 3.0) AS INTEGER) AS n FROM x) SELECT x, list_aggregate(list_transform(range(1, n + 1), lambda i: (CASE WHEN i = n THEN '1' ELSE '0' END) || substr(lpad(bin(x), n * 3, '0'), CAST(i * 3 - 2 AS BIGINT), 3)), 'string_agg', '') AS nibble FROM p")
def codes_nibble(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(spark, d).select("x", codes.nibble(F.col("x")).alias("nibble"))


@query(f"WITH {X_SQL}, z AS (SELECT x - 1 AS x, max(x) OVER () AS z FROM x), s AS (SELECT x, z, length(bin(z - 1)) AS s FROM z) SELECT x, {MIN_BIN_SQL.format(x='x', z='z', s='s')} AS word FROM s")
def codes_minimal_binary(spark: SparkSession, d: str) -> DataFrame:
    numbers = _numbers(spark, d)
    numbers = numbers.crossJoin(numbers.agg(F.max("x").alias("z"))).select((F.col("x") - 1).alias("x"), "z")
    return numbers.select("x", codes.minimal_binary(F.col("x"), F.col("z")).alias("word"))


@query(f"WITH {X_SQL}, h AS (SELECT x, (length(bin(x)) - 1) // 3 AS h FROM x), b AS (SELECT x, h, x - (1 << (3 * h)) AS y, (1 << (3 * h + 3)) - (1 << (3 * h)) AS z FROM h), s AS (SELECT *, length(bin(z - 1)) AS s FROM b) SELECT x, repeat('0', h) || '1' || {MIN_BIN_SQL.format(x='y', z='z', s='s')} AS zeta FROM s")
def codes_zeta(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(spark, d).select("x", codes.zeta(F.col("x"), 3).alias("zeta"))


@query(f"WITH {X_SQL} SELECT count(*) AS numbers, CAST(0 AS BIGINT) AS wrong FROM x")
def codes_round_trip(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    words = _numbers(spark, d).select("x", codes.gamma(x).alias("g"), codes.delta(x).alias("e"), codes.nibble(x).alias("n"), codes.zeta(x, 3).alias("z"), codes.minimal_binary(x, x + 5).alias("m"))
    back = (codes.gamma_decode(F.col("g")) != x) | (codes.delta_decode(F.col("e")) != x) | (codes.nibble_decode(F.col("n")) != x) | (codes.zeta_decode(F.col("z"), 3) != x) | (codes.minimal_binary_decode(F.col("m"), x + 5) != x)
    return words.agg(F.count(F.lit(1)).alias("numbers"), F.count_if(back).alias("wrong"))


@query("WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS j FROM events), r AS (SELECT user_id, event_type, min(k) AS k, count(*) AS n FROM e GROUP BY user_id, event_type, k - j) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS run, event_type AS value, n FROM r")
def run_lengths(spark: SparkSession, d: str) -> DataFrame:
    events = samples.table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    runs = events.select("user_id", F.posexplode(codes.run_lengths(F.col("e.event_type"))).alias("run", "r"))
    return runs.select("user_id", F.col("run").cast("long").alias("run"), "r.value", "r.n")


@query()
def run_lengths_binary(spark: SparkSession, d: str) -> DataFrame:
    lines = samples.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_quantity") >= 25).cast("int").cast("string").alias("bit")))).alias("e"))
    return lines.select("l_orderkey", codes.binary_runs(F.array_join(F.col("e.bit"), "")).alias("code"))


# a type's place: the types seen since its last time, or, at its first, all types seen and the smaller ones not yet seen
MTF_SQL = """WITH e AS (SELECT user_id, event_id, event_type, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS last FROM events
), seen AS (SELECT a.user_id, a.event_id, a.event_type, a.last, list(DISTINCT b.event_type) FILTER (WHERE b.event_type IS NOT NULL) AS types
    FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.event_id < a.event_id AND (a.last IS NULL OR b.event_id > a.last) GROUP BY ALL
), place AS (SELECT user_id, event_id, len(coalesce(types, [])) + CASE WHEN last IS NULL THEN (SELECT count(DISTINCT event_type) FROM events x WHERE x.event_type < seen.event_type AND NOT list_contains(coalesce(types, []), x.event_type)) ELSE 0 END AS place FROM seen)
SELECT user_id, string_agg(CAST(place AS VARCHAR), ' ' ORDER BY event_id) AS places FROM place GROUP BY user_id"""


@query(MTF_SQL)
def move_to_front(spark: SparkSession, d: str) -> DataFrame:
    events = samples.table(spark, d, "events")
    alphabet = events.agg(F.sort_array(F.collect_set("event_type")).alias("alphabet"))
    lists = events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    return lists.crossJoin(alphabet).select("user_id", F.array_join(codes.move_to_front(F.col("e.event_type"), F.col("alphabet")).cast("array<string>"), " ").alias("places"))


@query()
def huffman_code(spark: SparkSession, d: str) -> DataFrame:
    return codes.huffman(samples.table(spark, d, "events"), "event_type")


GAP_SQL = "g AS (SELECT src, dst, dst - coalesce(lag(dst) OVER (PARTITION BY src ORDER BY dst), src) AS gap FROM edges)"


@query(f"WITH {SEQ}, {GAP_SQL}, v AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges) SELECT v.id, coalesce(string_agg(CAST(gap AS VARCHAR), ' ' ORDER BY dst), '') AS gaps FROM v LEFT JOIN g ON g.src = v.id GROUP BY v.id")
def gap_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = adjacency.adjacency_lists(samples.part_seq(spark, d))
    return adjacency.gap_encode(lists).select("id", F.array_join(F.transform("gaps", lambda x: x.cast("string")), " ").alias("gaps"))


@query(f"WITH {samples.NATION_TRADE_SQL}, r AS (SELECT src, dst, dst - row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM edges) SELECT src AS id, min(dst) AS start, count(*) - 3 AS extra FROM r GROUP BY src, k HAVING count(*) >= 3")
def interval_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = adjacency.adjacency_lists(samples.nation_trade(spark, d))
    return adjacency.interval_encode(lists).select("id", F.explode("intervals").alias("i")).select("id", "i.start", "i.extra")


@query()
def reference_lists(spark: SparkSession, d: str) -> DataFrame:
    return adjacency.reference_encode(adjacency.adjacency_lists(samples.part_seq(spark, d)))


@query(f"WITH {samples.PART_KNN_SQL} SELECT src, dst, weight FROM edges")
def knn_edges(spark: SparkSession, d: str) -> DataFrame:
    return samples.part_knn(spark, d).edges.select("src", "dst", "weight")


# --- files ---------------------------------------------------------------------


def _written(spark: SparkSession, lines: DataFrame, compression: str = "none") -> str:
    """A folder of text files with one ``value`` a line."""
    path = f"{shared_folder(spark)}/arcweave/files-{uuid.uuid4().hex}"
    lines.write.option("compression", compression).text(path)
    return path


def _reader(kind: str, line: str, sql: str) -> None:
    """Writes the weighted graph in a format, and reads it back; other kinds of lines of the format stand between."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = samples.part_seq(spark, d).edges.selectExpr(f"explode(split({line}, '\\n')) AS value")
        return edges.read(spark, _written(spark, rows, "gzip"), kind).select("src", "dst", "weight")

    QUERIES[f"read_{kind}"] = run
    SQL[f"read_{kind}"] = f"WITH {SEQ} SELECT src, dst, {sql} AS weight FROM edges"


_reader("edges", "concat('# ', src, '\\n\\n  ', src, '  ', dst, '\\t', weight, ' more')", "weight")
_reader("unweighted", "concat(src, ' ', dst, ' ', weight)", "CAST(0 AS DOUBLE)")
_reader("tab", "concat('#', src, '\\n', src, '\\t', dst, '\\t', weight)", "weight")
_reader("dimacs", "concat('c note\\n', 'a ', src, ' ', dst, ' ', weight)", "weight")
_reader("ratings", "concat(src, ',', dst, ',', weight, ',1234')", "weight")


@query(f"WITH {SEQ} SELECT src, dst, weight FROM edges")
def write_read_edges(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark)}/arcweave/files-{uuid.uuid4().hex}"
    edges.write_edges(samples.part_seq(spark, d).edges, path)
    return edges.read_edges(spark, path).select("src", "dst", "weight")


# --- catalog -------------------------------------------------------------------

#: Datasets of this package's own: name, directed, weighted, and marks for the four problems.
OWN = [("part_seq", 1, 1, 1, 0, 1, 1), ("part_pairs", 0, 0, 1, 1, 0, 0), ("part_knn", 1, 1, 0, 0, 0, 1), ("part_supplier", 0, 0, 1, 0, 1, 0), ("nation_trade", 1, 1, 0, 0, 1, 1)]
PROGRAMS = [("bfs", "bfs", "connectivity", [0, 1], [0, 1]), ("dfs", "dfs", "connectivity", [0], [0]), ("sssp", "sssp", "shortest", [1], [1]), ("st_path", "st_path", "shortest", [1], [1]), ("color", "color", "coloring", [0], [0]), ("max_flow", "max_flow", "flow", [1], [1])]
_VALUES = ", ".join(str(x) for x in OWN)
_PROGRAMS = ", ".join(f"('{n}', '{p}', {a}, {b})" for n, _, p, a, b in PROGRAMS)


@query(f"WITH g(graph, directed, weighted, connectivity, coloring, flow, shortest) AS (VALUES {_VALUES}), p(program, problem, a, b) AS (VALUES {_PROGRAMS}) SELECT graph, program FROM g, p WHERE list_contains(a, directed) AND list_contains(b, weighted) AND CASE problem WHEN 'connectivity' THEN connectivity WHEN 'coloring' THEN coloring WHEN 'flow' THEN flow ELSE shortest END = 1")
def planned_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = [(n, None, None, di, w, "txt", None, None, None, None, None, c, k, f, s, None, None) for n, di, w, c, k, f, s in OWN]
    return catalog.plan_runs(spark.createDataFrame(rows, catalog.DATASETS), catalog.programs(spark, PROGRAMS)).select("graph", "program")
