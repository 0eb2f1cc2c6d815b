"""Tables behind screens and reports: aggregates of signals, summaries, flows and drawings of call graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbom.functions import dims
from sparkbom.operators import graph as G
from sparkbom.operators import match as M
from sparkbom.operators import signals as S
from sparkbom.plans.match_sql import FLOW, FULL, RISK, SIGNALS, _mask, _names
from sparkbom.session import cut, table


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "nodes")
    return S.argument_signals(M.matched(nodes), nodes)


def _assets(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "nodes")
    return S.assets(cut(M.matched(nodes), "matched"), nodes, table(spark, sf, "edges"))


def signal_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    """Per call the first mode, padding and key size that an argument tells, and what its arguments mention."""
    s = _signals(spark, sf)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("index"))).alias(c)
    plays = lambda r: F.bool_or((F.col("role") == r) | (F.col(f"{r}_value").isNotNull() if r != "randomness" else F.lit(False))).alias(f"mentions_{r}")
    return s.groupBy("id").agg(first("mode"), first("padding"), first("key_size"), F.bool_or("is_literal").alias("has_literal"), *(plays(r) for r in ("key", "salt", "iv", "nonce", "randomness")))


def sources_by_class(spark: SparkSession, sf: str) -> DataFrame:
    """Per call and class of data the arguments whose words tell it, in their order, each once."""
    a = M.matched(table(spark, sf, "nodes")).select("id", F.posexplode("args").alias("index", "argument")).withColumn("low", F.lower("argument"))
    a = a.select("id", "index", "argument", F.explode(S.classes_of(S.source_mask(F.col("low")))).alias("class"))
    first = a.groupBy("id", "class", "argument").agg(F.min("index").alias("index"))
    return first.groupBy("id", "class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "argument"))), lambda x: x["argument"]), " | ").alias("arguments"))


def viewer_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Assets of each repository by risk, and their algorithms."""
    a = _assets(spark, sf).where("asset_class = 'primary_asset'")
    level = lambda x: F.count_if(F.lower("risk") == x).alias(x)
    return a.groupBy("root").agg(F.count("*").alias("total"), level("high"), level("medium"), level("low"), F.array_join(F.array_sort(F.collect_set("algorithm")), ",").alias("algorithms"))


def risk_tags(spark: SparkSession, sf: str) -> DataFrame:
    """How often each tag stands, with its explanation."""
    t = _assets(spark, sf).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return t.select("tag", "n", F.coalesce(F.try_element_at(M._map(dims.TAG_TEXTS), F.col("tag")), F.concat(F.lit("Risk tag: "), "tag")).alias("text"))


def flow_edges(spark: SparkSession, sf: str) -> DataFrame:
    """From a source through a role and an operation to a sink: how many calls."""
    a = _assets(spark, sf)
    steps = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"{r}_source").alias("source")) for r in dims.ROLES)))
    f = a.select("operation", "sink_type", steps.alias("s")).where("s.source is not null")
    return f.groupBy(F.col("s.source").alias("source"), F.col("s.role").alias("role"), "operation", "sink_type").agg(F.count("*").alias("n"))


def function_subgraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of each function (within it, or the function itself) and the edges between them."""
    n = cut(G.nodes_of(table(spark, sf, "nodes"), "root", "kind", "name", "function").select("root", "id", F.coalesce("function", F.when(F.col("kind") == "function", F.col("name"))).alias("fn")).where("fn is not null"), "nodes")
    e = table(spark, sf, "edges").select("source", "target")
    inner = e.join(n.withColumnRenamed("id", "source"), "source").join(n.select(F.col("id").alias("target"), F.col("root").alias("r"), F.col("fn").alias("f")), "target").where("root = r and fn = f")
    return n.groupBy("root", "fn").agg(F.count("*").alias("nodes")).join(inner.groupBy("root", "fn").agg(F.count("*").alias("edges")), ["root", "fn"], "left").select("root", "fn", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


def call_graph_dot(spark: SparkSession, sf: str) -> DataFrame:
    """The call graph of each repository in the DOT language."""
    name = lambda c: F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}]", "_"), 1, 80)
    g = cut(G.call_graph(table(spark, sf, "nodes"), table(spark, sf, "edges")), "calls")
    fns = g.select("root", F.col("caller").alias("fn")).union(g.select("root", "callee")).distinct()
    label = F.replace(F.replace("fn", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    nodes = fns.select("root", F.lit(1).alias("part"), F.concat(F.lit("  "), name("fn"), F.lit(' [label="'), label, F.lit('"];')).alias("line"))
    edges = g.select("root", F.lit(2).alias("part"), F.concat(F.lit("  "), name("caller"), F.lit(" -> "), name("callee"), F.lit(";")).alias("line"))
    roots = g.select("root").distinct()
    frame = lambda part, line: roots.select("root", F.lit(part).alias("part"), F.lit(line).alias("line"))
    return nodes.unionByName(edges).unionByName(frame(0, "digraph calls {")).unionByName(frame(3, "}"))


QUERIES = {f.__name__: f for f in (signal_aggregates, sources_by_class, viewer_summary, risk_tags, flow_edges, function_subgraphs, call_graph_dot)}

_id = "substr(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', '_', 'g'), 1, 80)".format
_first = lambda c, a: f"arg_min({c}, idx) FILTER ({c} IS NOT NULL) AS {a}"
_N = "n AS (SELECT DISTINCT root, id, coalesce(function, CASE WHEN lower(trim(kind)) = 'function' THEN name END) AS fn FROM nodes WHERE id IS NOT NULL AND coalesce(function, CASE WHEN lower(trim(kind)) = 'function' THEN name END) IS NOT NULL)"
SQL = {
    "signal_aggregates": SIGNALS
    + f", t AS (SELECT *, CASE WHEN n IN (64, 112, 128, 192, 2048, 3072, 4096) OR n BETWEEN 256 AND 8192 THEN n END AS size FROM s) SELECT id, {_first('said_mode', 'mode')}, {_first('said_padding', 'padding')}, {_first('size', 'key_size')}, bool_or(is_literal) AS has_literal, "
    + ", ".join(f"bool_or(role = '{r}' OR {r}_value IS NOT NULL) AS mentions_{r}" for r in ("key", "salt", "iv", "nonce")) + ", bool_or(role = 'randomness') AS mentions_randomness FROM t GROUP BY id",
    "sources_by_class": FULL + f""", a AS (SELECT id, unnest(range(len(args))) AS idx, args FROM m), b AS (SELECT id, idx, args[idx + 1] AS argument FROM a), k AS (SELECT *, {_mask('argument')} AS mask FROM b),
x AS (SELECT id, argument, idx, unnest({_names('mask')}) AS class FROM k), f AS (SELECT id, class, argument, min(idx) AS idx FROM x GROUP BY 1, 2, 3) SELECT id, class, string_agg(argument, ' | ' ORDER BY idx) AS arguments FROM f GROUP BY 1, 2""",
    "viewer_summary": RISK + " SELECT root, count(*) AS total, count(*) FILTER (risk = 'high') AS high, count(*) FILTER (risk = 'medium') AS medium, count(*) FILTER (risk = 'low') AS low, string_agg(DISTINCT algorithm, ',' ORDER BY algorithm) AS algorithms FROM r WHERE asset_class = 'primary_asset' GROUP BY root",
    "risk_tags": RISK + """, t AS (SELECT unnest(string_split(tags, ',')) AS tag FROM r WHERE tags <> '') SELECT tag, count(*) AS n, CASE tag WHEN 'weak_key_size' THEN 'RSA key size below 2048 bits or ECC below 256 bits' WHEN 'low_iteration_count' THEN 'PBKDF2 iteration count below 100,000'
 WHEN 'ecb_mode_detected' THEN 'ECB mode detected; identical plaintexts produce identical ciphertexts' WHEN 'deprecated_algorithm' THEN 'Algorithm is deprecated (e.g., DES, MD5, SHA-1)' WHEN 'hardcoded_material' THEN 'Cryptographic material may be hardcoded' WHEN 'weak_random_source' THEN 'Weak randomness source for cryptographic operation' ELSE 'Risk tag: ' || tag END AS text FROM t GROUP BY tag""",
    "flow_edges": FLOW + " SELECT source, role, operation, sink_type, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT {r}_source AS source, '{r}' AS role, operation, sink_type FROM flow" for r in ("key", "data", "iv", "nonce", "salt", "randomness")) + ") WHERE source IS NOT NULL GROUP BY 1, 2, 3, 4",
    "function_subgraphs": f"""WITH {_N}, c AS (SELECT root, fn, count(*) AS nodes FROM n GROUP BY 1, 2), e AS (SELECT a.root, a.fn, count(*) AS edges FROM edges e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target AND b.root = a.root AND b.fn = a.fn GROUP BY 1, 2)
SELECT c.root, c.fn, nodes, coalesce(edges, 0) AS edges FROM c LEFT JOIN e ON e.root = c.root AND e.fn = c.fn""",
    "call_graph_dot": f"""WITH n AS (SELECT DISTINCT root, id, coalesce(function, name) AS fn FROM nodes WHERE id IS NOT NULL AND name IS NOT NULL),
g AS (SELECT DISTINCT a.root, a.fn AS caller, b.fn AS callee FROM edges e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target AND b.root = a.root WHERE upper(trim(e.kind)) = 'CALLS' AND a.fn <> b.fn),
f AS (SELECT root, caller AS fn FROM g UNION SELECT root, callee FROM g)
SELECT root, 1 AS part, '  ' || {_id('fn')} || ' [label="' || replace(replace(fn, '\\', '\\\\'), '"', '\\"') || '"];' AS line FROM f UNION ALL SELECT root, 2, '  ' || {_id('caller')} || ' -> ' || {_id('callee')} || ';' FROM g
UNION ALL SELECT DISTINCT root, 0, 'digraph calls {{' FROM g UNION ALL SELECT DISTINCT root, 3, '}}' FROM g""",
}
