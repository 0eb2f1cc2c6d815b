"""Queries on hierarchies (p2_) and drifting schemas (p3_), with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbom.operators import hierarchy as H
from sparkbom.operators import schema_drift as D
from sparkbom.session import cut, table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Root and depth of every node from the whole method: sizes upward, offsets of siblings, and the way down from the roots."""
    return H.hierarchy(H.containment_links(table(spark, sf, "edges"))).select("node_id", "root_id", "depth")


def p2_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The nested-set range of every node within its tree: the compact form of all descendants and ancestors."""
    return H.hierarchy(H.containment_links(table(spark, sf, "edges"))).where("depth >= 0").select("node_id", "root_id", "depth", "first", "last")


def p2_paths(spark: SparkSession, sf: str) -> DataFrame:
    tree = H.hierarchy(H.containment_links(table(spark, sf, "edges")), paths=True)
    return tree.where("depth >= 0").select("node_id", "depth", F.concat_ws(" > ", "path").alias("path"))


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """All descendants of all nodes, by preorder ranges."""
    return H.descendants(cut(H.hierarchy(H.containment_links(table(spark, sf, "edges"))), "tree"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return D.changes(table(spark, sf, "cbom_files"))


def p3_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return D.path_statistics(cut(D.path_values(table(spark, sf, "cbom_files")), "leaves"))


def p3_table(spark: SparkSession, sf: str) -> DataFrame:
    out = D.consistent_table(table(spark, sf, "cbom_files"))
    return out.withColumn("failed_casts", F.concat_ws(",", "failed_casts"))


LINKS = """links AS (SELECT target AS child, min(source) AS parent FROM edges
  WHERE starts_with(upper(trim(kind)), 'AST_') AND source IS NOT NULL AND target IS NOT NULL GROUP BY target),
ids AS (SELECT child AS id FROM links UNION SELECT parent FROM links)"""
DOWN = """tree AS (SELECT id AS node_id, id AS root_id, 0 AS depth FROM ids WHERE id NOT IN (SELECT child FROM links)
  UNION ALL SELECT l.child, t.root_id, t.depth + 1 FROM tree t JOIN links l ON l.parent = t.node_id)"""

_TYPE = "CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'fractional' WHEN 'ARRAY' THEN 'list' ELSE 'whole' END"
SQL = {
    "p3_statistics": rf"""WITH d AS (SELECT DISTINCT cbom_id, payload FROM cbom_files WHERE cbom_id IS NOT NULL AND source IS NOT NULL AND generated_at IS NOT NULL AND json_valid(payload)),
t AS (SELECT d.cbom_id, regexp_replace(regexp_replace(replace(j.fullkey, '"', ''), '^\$\.', ''), '^cryptographic_assets\[\d+\]', 'cryptographic_assets') AS field, j.type, j.atom FROM d, json_tree(d.payload) j),
l AS (SELECT cbom_id, field, {_TYPE} AS type FROM t WHERE NOT contains(field, '[') AND type NOT IN ('OBJECT', 'NULL') AND NOT (field = 'cryptographic_assets' AND type = 'ARRAY') AND NOT regexp_matches(field, '^(supporting_artifacts|summary)(\.|$)') AND coalesce(CAST(atom AS VARCHAR), '') <> '"unknown"'),
p AS (SELECT cbom_id, field, count(*) AS n, list(DISTINCT type) AS types FROM l GROUP BY 1, 2)
SELECT field, type, count(*) AS documents, CAST(sum(n) AS BIGINT) AS occurrences FROM (SELECT cbom_id, field, n, unnest(types) AS type FROM p) GROUP BY 1, 2""",
    "p2_found": f"""WITH RECURSIVE {LINKS}, {DOWN},
stuck AS (SELECT l.* FROM links l WHERE l.child NOT IN (SELECT node_id FROM tree)),
walk AS (SELECT child AS id, parent AS cur FROM stuck UNION SELECT w.id, s.parent FROM walk w JOIN stuck s ON s.child = w.cur),
oncycle AS (SELECT DISTINCT id FROM walk WHERE id = cur),
low AS (SELECT w.id, min(w.cur) AS low FROM walk w JOIN oncycle c ON c.id = w.cur GROUP BY w.id)
SELECT node_id, root_id, CAST(depth AS INTEGER) AS depth FROM tree UNION ALL SELECT id, low, -1 FROM low""",
    "p2_ranges": f"""WITH RECURSIVE {LINKS}, tree AS (SELECT id AS node_id, id AS root_id, 0 AS depth, [id] AS path FROM ids WHERE id NOT IN (SELECT child FROM links)
  UNION ALL SELECT l.child, t.root_id, t.depth + 1, list_append(t.path, l.child) FROM tree t JOIN links l ON l.parent = t.node_id),
sizes AS (SELECT node, count(*) AS size FROM (SELECT unnest(path) AS node FROM tree) GROUP BY node),
placed AS (SELECT node_id, root_id, depth, row_number() OVER (PARTITION BY root_id ORDER BY path) - 1 AS first FROM tree)
SELECT node_id, root_id, CAST(depth AS INTEGER) AS depth, first, first + size - 1 AS last FROM placed JOIN sizes ON node = node_id""",
    "p2_paths": f"""WITH RECURSIVE {LINKS},
tree AS (SELECT id AS node_id, 0 AS depth, id AS path FROM ids WHERE id NOT IN (SELECT child FROM links)
  UNION ALL SELECT l.child, t.depth + 1, t.path || ' > ' || l.child FROM tree t JOIN links l ON l.parent = t.node_id)
SELECT node_id, CAST(depth AS INTEGER) AS depth, path FROM tree""",
    "p2_descendants": f"""WITH RECURSIVE {LINKS}, {DOWN},
below AS (SELECT t.node_id AS ancestor_id, l.child AS node_id, 1 AS below FROM tree t JOIN links l ON l.parent = t.node_id
  UNION ALL SELECT b.ancestor_id, l.child, b.below + 1 FROM below b JOIN links l ON l.parent = b.node_id)
SELECT ancestor_id, node_id, CAST(below AS INTEGER) AS below FROM below""",
}

QUERIES = {f.__name__: f for f in (p2_found, p2_ranges, p2_paths, p2_descendants, p3_found, p3_statistics, p3_table)}
