"""The code graph as two DataFrames: views, adjacency, degrees, call graph, chains, reachability and induced parts.

Kinds are compared without case and outer blanks. Repeated node rows are one node (the latest row wins); edges stay a bag unless said
otherwise. Null ends join nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkbom.session import cut


def kind(c: str = "kind") -> Column:
    return F.lower(F.trim(c))


def latest(rows: DataFrame, key: str = "id") -> DataFrame:
    """One row per key: the one that was loaded last, where rows say when; of equal ones any."""
    if "loaded_at" not in rows.columns:
        return rows.dropDuplicates([key])
    rest = [c for c in rows.columns if c != key]
    order = F.coalesce(F.col("loaded_at").cast("timestamp_ntz"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*").select(*rows.columns)


def nodes_of(nodes: DataFrame, *columns: str) -> DataFrame:
    """One row per node id. With ``columns`` only these and the id pass the exchange; kind is among them if it is named."""
    rows = nodes.where("id is not null")
    if columns:
        when = ["loaded_at"] if "loaded_at" in nodes.columns else []
        rows = rows.select("id", *(c for c in columns if c != "id"), *when)
    out = latest(rows)
    out = out.drop("loaded_at") if columns else out
    return out.withColumn("kind", kind()) if "kind" in out.columns else out


def calls_of(nodes: DataFrame) -> DataFrame:
    """Call nodes with their properties as columns."""
    p = F.col("properties")
    one = nodes.where((kind() == "call") & F.col("id").isNotNull())
    arguments = F.coalesce(p["arguments"], F.array().cast("array<string>"))
    types = F.transform(p["literal_arguments"], lambda x: x["py_type"])
    keep = ["loaded_at"] if "loaded_at" in nodes.columns else []
    # only the columns in use pass the exchange
    narrow = one.select("root", "id", "name", "file", "line", "function", p["resolved_name"].alias("resolved_name"), p["callee"].alias("callee"), arguments.alias("arguments"), p["keywords"].alias("keywords"), types.alias("literal_types"), *keep)
    return latest(narrow).drop("loaded_at")


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce(F.nullif(kind(), F.lit("")), F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))


def adjacency(edges: DataFrame, side: str) -> DataFrame:
    """``(id, kind, n)``: the bag of edges at each node; ``side`` is the end that the node is: source (outgoing) or target."""
    return edges.where(F.col(side).isNotNull()).groupBy(F.col(side).alias("id"), F.upper(F.trim("kind")).alias("kind")).agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, incoming, outgoing)`` in one pass: both ends of every edge become rows that partial sums shrink at once."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))))
    return edges.select(ends.alias("e")).select("e.*").where("id is not null").groupBy("id").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))


def neighbors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge with its target's kind and name; both null where the target is missing."""
    n = nodes_of(nodes, "kind", "name").select(F.col("id").alias("target"), F.col("kind").alias("target_kind"), F.col("name").alias("target_name"))
    return edges.where("target is not null").join(n, "target", "left").select("source", "target", F.upper(F.trim("kind")).alias("kind"), "target_kind", "target_name")


def call_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(root, caller, callee)`` by name: distinct CALLS edges both of whose ends are found in one repository and named."""
    n = nodes_of(nodes, "root", "name", "function").where("name is not null").select("root", "id", F.coalesce("function", "name").alias("fn"))
    e = edges.where(F.upper(F.trim("kind")) == "CALLS").select("source", "target").distinct()
    source = n.select("root", F.col("id").alias("source"), F.col("fn").alias("caller"))
    target = n.select(F.col("root").alias("to"), F.col("id").alias("target"), F.col("fn").alias("callee"))
    return e.join(source, "source").join(target, "target").where("root = to and caller <> callee").select("root", "caller", "callee").distinct()


def resolve_calls(nodes: DataFrame) -> DataFrame:
    """Synthetic call edges ``(source, target)``: a call's full name, else its last part, names a function of the same root;
    of equal names the last by id counts. Two hash joins; no self edges; distinct."""
    f = nodes_of(nodes, "root", "kind", "name").where("kind = 'function' and name is not null").select("root", "name", "id")
    short = F.substring_index("name", ".", -1)
    full_of = f.groupBy("root", "name").agg(F.max("id").alias("full_id"))
    short_of = f.groupBy("root", short.alias("short")).agg(F.max("id").alias("short_id"))
    c = calls_of(nodes).select("root", F.col("id").alias("source"), F.coalesce("resolved_name", "name").alias("name")).where("name is not null")
    c = c.withColumn("short", short)
    out = c.join(full_of, ["root", "name"], "left").join(short_of, ["root", "short"], "left")
    return out.select("source", F.coalesce("full_id", "short_id").alias("target")).where("target is not null and source <> target").distinct()


def longest_chains(pairs: DataFrame, cap: int = 24) -> DataFrame:
    """``(root, fn, chain)`` of ``(root, caller, callee)``: the longest simple chain of callers that ends at each function, at most
    ``cap`` long, topmost first; of equal lengths the one whose path from the leaf sorts first.

    A function all of whose callers are settled is settled by the best of them, so everything above recursion takes one pass
    per level and no paths are listed; each pass follows the functions settled by the last one only. From functions on or below a
    cycle simple paths are enumerated, and only up to the first settled function, whose best chain completes them: their number
    may grow with the branches of the cycle to the power of ``cap``, as a longest simple path is hard to find in general."""
    key = ["root", "fn"]
    pairs = cut(pairs.select("root", "caller", "callee").where("caller <> callee").distinct(), "pairs")
    fns = pairs.select("root", F.col("caller").alias("fn")).union(pairs.select("root", "callee")).distinct()
    wanted = cut(pairs.groupBy("root", F.col("callee").alias("fn")).agg(F.count("*").alias("callers")), "wanted")
    front = cut(fns.join(wanted, key, "left_anti").select("root", "fn", F.array("fn").alias("path")), "chain")  # leaf first
    settled, open_ = front, wanted.select(*key, "callers", F.lit(None).cast("struct<n:int,path:array<string>>").alias("b"))
    while not front.isEmpty():
        came = pairs.join(front.select("root", F.col("fn").alias("caller"), "path"), ["root", "caller"]).groupBy("root", F.col("callee").alias("fn"))
        came = came.agg(F.count("*").alias("more"), F.min(F.struct((-F.size("path")).alias("n"), F.col("path"))).alias("c"))
        state = open_.join(came, key, "left")
        best = F.when(F.col("b").isNull(), F.col("c")).when(F.col("c").isNull(), F.col("b")).otherwise(F.least("b", "c"))
        state = cut(state.select(*key, (F.col("callers") - F.coalesce("more", F.lit(0))).alias("callers"), best.alias("b")), "open")
        front = cut(state.where("callers = 0").select(*key, F.slice(F.concat(F.array("fn"), "b.path"), 1, cap).alias("path")), "chain")
        settled, open_ = settled.unionByName(front), state.where("callers > 0")
    settled, rest = cut(settled, "settled"), cut(open_.select(*key), "rest")
    front = rest.select(*key, F.array("fn").alias("path"))
    found, length = front, 1
    while length < cap and not front.isEmpty():
        length += 1
        step = front.withColumn("callee", F.element_at("path", -1)).join(pairs, ["root", "callee"]).where(~F.array_contains("path", F.col("caller"))).select("root", "fn", "path", "caller")
        step = cut(step.join(settled.select("root", F.col("fn").alias("caller"), F.col("path").alias("above")), ["root", "caller"], "left"), "step")
        closed = step.where("above is not null").select("root", "fn", F.slice(F.concat("path", "above"), 1, cap).alias("path"))
        front = step.where("above is null").select("root", "fn", F.concat("path", F.array("caller")).alias("path"))
        found = found.unionByName(closed).unionByName(front)
    longest = found.groupBy(*key).agg(F.min(F.struct((-F.size("path")).alias("n"), F.col("path"))).alias("b")).select(*key, F.col("b.path").alias("path"))
    return settled.unionByName(longest).select(*key, F.reverse("path").alias("chain"))


def reach(edges: DataFrame, starts: DataFrame, kinds: tuple[str, ...] = ("DFG", "DATA_FLOW", "REACHES"), hops: int = 24) -> DataFrame:
    """``(start, id, depth)``: nodes within ``hops`` undirected steps of each start, at their least depth. All starts advance
    together; a visited pair is never visited again."""
    e = edges.where(F.upper(F.trim("kind")).isin(*kinds) & F.col("source").isNotNull() & F.col("target").isNotNull()).select("source", "target").distinct()
    e = cut(e.union(e.select("target", "source")).toDF("id", "to").distinct(), "flow")
    seen = cut(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct(), "reach")
    front, depth = seen, 0
    while depth < hops:
        depth += 1
        step = front.join(e, "id").select("start", F.col("to").alias("id")).distinct().join(seen.select("start", "id"), ["start", "id"], "left_anti")
        step = cut(step.select("start", "id", F.lit(depth).alias("depth")), "front")
        if step.isEmpty():
            break
        seen, front = cut(seen.unionByName(step), "reach"), step
    return seen


def reaching_nodes(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """``(start, id, depth, kind, name)``: what :func:`reach` found, but for the starts themselves; kind and name are null where the node
    is missing."""
    n = nodes_of(nodes, "kind", "name")
    return reached.where("depth > 0").join(n, "id", "left").select("start", "id", "depth", "kind", "name")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids``: two semi joins."""
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def first_nodes(nodes: DataFrame, n: int) -> DataFrame:
    """The first ``n`` nodes of each root by id, for drawings."""
    w = Window.partitionBy("root").orderBy("id")
    return nodes_of(nodes, "root").withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def layout(first: DataFrame) -> DataFrame:
    """``(root, id, x, y)`` on a circle: whole pixels, cut towards zero."""
    size = F.count("*").over(Window.partitionBy("root"))
    angle = 2 * F.pi() * (F.col("pos") - 1) / F.col("size")
    r = F.least(F.lit(300), F.greatest(F.lit(110), 8 * F.col("size")))
    return first.withColumn("size", size).select("root", "id", (600 + r * F.cos(angle)).cast("int").alias("x"), (350 + r * F.sin(angle)).cast("int").alias("y"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(root, part, line)``: a drawing per root in the DOT language: a head (part 0), nodes (1), edges (2) and a foot (3)."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    n = nodes_of(nodes, "root", "name", "kind").select("root", F.lit(1).alias("part"), F.concat(F.lit('  "'), esc(F.col("id")), F.lit('" [label="'), esc(F.coalesce("name", "kind")), F.lit('"];')).alias("line"))
    e = edges.where("source is not null and target is not null").select("root", F.lit(2).alias("part"), F.concat(F.lit('  "'), esc(F.col("source")), F.lit('" -> "'), esc(F.col("target")), F.lit('" [label="'), esc(F.upper(F.trim("kind"))), F.lit('"];')).alias("line"))
    ends = n.select("root").union(e.select("root")).distinct()
    frame = lambda part, line: ends.select("root", F.lit(part).alias("part"), F.lit(line).alias("line"))
    return n.unionByName(e).unionByName(frame(0, "digraph G {")).unionByName(frame(3, "}"))
