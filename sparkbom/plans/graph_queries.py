"""Queries on the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbom.operators import graph as G
from sparkbom.operators.documents import call_counts
from sparkbom.session import cut, table


def graph_summary_node_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return G.kind_counts(table(spark, sf, "nodes"))


def graph_summary_edge_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return G.kind_counts(table(spark, sf, "edges"))


def incoming_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.adjacency(table(spark, sf, "edges"), "target")


def outgoing_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.adjacency(table(spark, sf, "edges"), "source")


def degree(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(table(spark, sf, "edges"))


def neighbor_summary(spark: SparkSession, sf: str) -> DataFrame:
    return G.neighbors(table(spark, sf, "nodes"), table(spark, sf, "edges")).groupBy("kind", "target_kind").agg(F.count("*").alias("n"), F.count_distinct("target_name").alias("names"))


def call_graph(spark: SparkSession, sf: str) -> DataFrame:
    return G.call_graph(table(spark, sf, "nodes"), table(spark, sf, "edges"))


def callers_and_callees(spark: SparkSession, sf: str) -> DataFrame:
    return call_counts(G.call_graph(table(spark, sf, "nodes"), table(spark, sf, "edges")))


def synthetic_calls(spark: SparkSession, sf: str) -> DataFrame:
    return G.resolve_calls(table(spark, sf, "nodes"))


def longest_call_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The longest simple chain of callers of every function."""
    g = cut(G.call_graph(table(spark, sf, "nodes"), table(spark, sf, "edges")), "calls")
    return G.longest_chains(g).select("root", "fn", F.size("chain").alias("length"), F.concat_ws(" > ", "chain").alias("chain"))


def bfs_min_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Reachability over data flow from every node that a finding names."""
    return G.reach(table(spark, sf, "edges"), table(spark, sf, "findings").where("node_id is not null").select(F.col("node_id").alias("id")))


def reaching_sources(spark: SparkSession, sf: str) -> DataFrame:
    """How many nodes of which kind reach the nodes of findings over data flow, by distance."""
    reached = bfs_min_depth(spark, sf)
    return G.reaching_nodes(table(spark, sf, "nodes"), reached).groupBy("kind", "depth").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


def induced_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between nodes of one file that has findings."""
    f = table(spark, sf, "findings").select("root", "file").distinct()
    ids = G.nodes_of(table(spark, sf, "nodes"), "root", "file").join(f, ["root", "file"], "left_semi").select("id")
    return G.induced(table(spark, sf, "edges").select("source", "target", F.upper(F.trim("kind")).alias("kind")), ids).groupBy("kind").agg(F.count("*").alias("n"))


def circular_layout(spark: SparkSession, sf: str) -> DataFrame:
    return G.layout(G.first_nodes(table(spark, sf, "nodes"), 300))


def dot_export(spark: SparkSession, sf: str) -> DataFrame:
    return G.dot_lines(table(spark, sf, "nodes"), table(spark, sf, "edges")).select("root", "part", "line")


QUERIES = {f.__name__: f for f in (graph_summary_node_kinds, graph_summary_edge_kinds, incoming_edges, outgoing_edges, degree, neighbor_summary, call_graph, callers_and_callees, synthetic_calls, longest_call_chain, bfs_min_depth, reaching_sources, induced_subgraph, circular_layout, dot_export)}

N = "n AS (SELECT DISTINCT root, id, lower(trim(kind)) AS kind, name, file, function, properties FROM nodes WHERE id IS NOT NULL)"
CG = f"""{N}, g AS (SELECT DISTINCT a.root, coalesce(a.function, a.name) AS caller, coalesce(b.function, b.name) AS callee FROM edges e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target AND b.root = a.root
WHERE upper(trim(e.kind)) = 'CALLS' AND a.name IS NOT NULL AND b.name IS NOT NULL AND coalesce(a.function, a.name) <> coalesce(b.function, b.name))"""
ESC = "replace(replace(replace({}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')"
SQL = {
    "graph_summary_node_kinds": "SELECT coalesce(nullif(lower(trim(kind)), ''), 'unknown') AS kind, count(*) AS n FROM nodes GROUP BY 1",
    "graph_summary_edge_kinds": "SELECT coalesce(nullif(lower(trim(kind)), ''), 'unknown') AS kind, count(*) AS n FROM edges GROUP BY 1",
    "incoming_edges": "SELECT target AS id, upper(trim(kind)) AS kind, count(*) AS n FROM edges WHERE target IS NOT NULL GROUP BY 1, 2",
    "outgoing_edges": "SELECT source AS id, upper(trim(kind)) AS kind, count(*) AS n FROM edges WHERE source IS NOT NULL GROUP BY 1, 2",
    "degree": "SELECT id, CAST(sum(i) AS BIGINT) AS incoming, CAST(sum(o) AS BIGINT) AS outgoing FROM (SELECT source AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT target, 1, 0 FROM edges) WHERE id IS NOT NULL GROUP BY id",
    "neighbor_summary": f"WITH {N} SELECT upper(trim(e.kind)) AS kind, n.kind AS target_kind, count(*) AS n, count(DISTINCT n.name) AS names FROM edges e LEFT JOIN n ON n.id = e.target WHERE e.target IS NOT NULL GROUP BY 1, 2",
    "call_graph": f"WITH {CG} SELECT root, caller, callee FROM g",
    "callers_and_callees": f"""WITH {CG} SELECT coalesce(a.root, b.root) AS root, coalesce(a.fn, b.fn) AS fn, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees FROM
(SELECT root, caller AS fn, count(*) AS callees FROM g GROUP BY 1, 2) a FULL JOIN (SELECT root, callee AS fn, count(*) AS callers FROM g GROUP BY 1, 2) b ON a.root = b.root AND a.fn = b.fn""",
    "synthetic_calls": f"""WITH {N}, f AS (SELECT root, name, id, list_extract(string_split(name, '.'), -1) AS short FROM n WHERE kind = 'function' AND name IS NOT NULL),
c AS (SELECT root, id, coalesce(properties.resolved_name, name) AS name FROM n WHERE kind = 'call' AND coalesce(properties.resolved_name, name) IS NOT NULL)
SELECT DISTINCT c.id AS source, coalesce(a.id, b.id) AS target FROM c
LEFT JOIN (SELECT root, name, max(id) AS id FROM f GROUP BY 1, 2) a ON a.root = c.root AND a.name = c.name
LEFT JOIN (SELECT root, short, max(id) AS id FROM f GROUP BY 1, 2) b ON b.root = c.root AND b.short = list_extract(string_split(c.name, '.'), -1)
WHERE coalesce(a.id, b.id) <> c.id""",
    "bfs_min_depth": """WITH RECURSIVE e AS (SELECT DISTINCT source AS id, target AS nxt FROM edges WHERE upper(trim(kind)) IN ('DFG', 'DATA_FLOW', 'REACHES') AND source IS NOT NULL AND target IS NOT NULL),
u AS (SELECT id, nxt FROM e UNION SELECT nxt, id FROM e),
w AS (SELECT DISTINCT node_id AS start, node_id AS id, 0 AS depth FROM findings WHERE node_id IS NOT NULL UNION SELECT w.start, u.nxt, w.depth + 1 FROM w JOIN u ON u.id = w.id WHERE w.depth < 24)
SELECT start, id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2""",
    "reaching_sources": f"""WITH RECURSIVE {N}, e AS (SELECT DISTINCT source AS id, target AS nxt FROM edges WHERE upper(trim(kind)) IN ('DFG', 'DATA_FLOW', 'REACHES') AND source IS NOT NULL AND target IS NOT NULL),
u AS (SELECT id, nxt FROM e UNION SELECT nxt, id FROM e),
w AS (SELECT DISTINCT node_id AS start, node_id AS id, 0 AS depth FROM findings WHERE node_id IS NOT NULL UNION SELECT w.start, u.nxt, w.depth + 1 FROM w JOIN u ON u.id = w.id WHERE w.depth < 24),
r AS (SELECT start, id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2)
SELECT n.kind, r.depth, count(*) AS n, count(DISTINCT n.name) AS names FROM r LEFT JOIN (SELECT DISTINCT id, kind, name FROM n) n ON n.id = r.id WHERE r.depth > 0 GROUP BY 1, 2""",
    "longest_call_chain": f"""WITH RECURSIVE {CG}, p AS (SELECT root, fn, [fn] AS path FROM (SELECT root, caller AS fn FROM g UNION SELECT root, callee FROM g)
UNION ALL SELECT p.root, p.fn, list_append(p.path, g.caller) FROM p JOIN g ON g.root = p.root AND g.callee = p.path[-1] WHERE NOT list_contains(p.path, g.caller) AND len(p.path) < 24),
b AS (SELECT root, fn, path, row_number() OVER (PARTITION BY root, fn ORDER BY len(path) DESC, path) AS r FROM p)
SELECT root, fn, CAST(len(path) AS INTEGER) AS length, array_to_string(list_reverse(path), ' > ') AS chain FROM b WHERE r = 1""",
    "induced_subgraph": f"""WITH {N}, i AS (SELECT DISTINCT n.id FROM n JOIN findings f ON f.root = n.root AND f.file = n.file)
SELECT upper(trim(kind)) AS kind, count(*) AS n FROM edges WHERE source IN (SELECT id FROM i) AND target IN (SELECT id FROM i) GROUP BY 1""",
    "circular_layout": f"""WITH {N}, p AS (SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY id) AS pos FROM n),
q AS (SELECT root, id, pos, count(*) OVER (PARTITION BY root) AS size FROM p WHERE pos <= 300)
SELECT root, id, CAST(trunc(600 + least(300, greatest(110, 8 * size)) * cos(2 * pi() * (pos - 1) / size)) AS INTEGER) AS x,
CAST(trunc(350 + least(300, greatest(110, 8 * size)) * sin(2 * pi() * (pos - 1) / size)) AS INTEGER) AS y FROM q""",
    "dot_export": f"""WITH {N} SELECT root, 1 AS part, '  "' || {ESC.format('id')} || '" [label="' || {ESC.format('coalesce(name, kind)')} || '"];' AS line FROM n
UNION ALL SELECT root, 2, '  "' || {ESC.format('source')} || '" -> "' || {ESC.format('target')} || '" [label="' || {ESC.format('upper(trim(kind))')} || '"];' FROM edges WHERE source IS NOT NULL AND target IS NOT NULL
UNION ALL SELECT root, p, l FROM (SELECT root FROM n UNION SELECT root FROM edges WHERE source IS NOT NULL AND target IS NOT NULL), (VALUES (0, 'digraph G {{'), (3, '}}')) AS v(p, l)""",
}
