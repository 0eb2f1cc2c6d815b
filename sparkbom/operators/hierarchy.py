"""Parent-child rows to full hierarchies: root, depth, subtree size, preorder range, path and descendants of every node.

Trees may be of any depth, so nothing here works level by level. All passes double their reach in each round:

* *up*: each node keeps a pointer to its 2^k-th ancestor and the size of its subtree down to 2^k levels; a node hands its
  size to the ancestor it points at, so sizes grow as ``S(v) += sum of S(u) over u that point at v``;
* *siblings*: prefix sums of subtree sizes give each child its offset within its parent;
* *down*: offsets add up along the pointers to preorder numbers, and steps to depths; where the pointers end are the roots.

A tree of depth d takes log2(d) rounds, and only nodes deeper than 2^k are looked up in round k. A node that is still
unprocessed when a round settles no further node has no root: it lies on a cycle or hangs off one.

Nulls: a link with a null end is no link. Repeated links count once. A node given several parents keeps the smallest one.
Empty input gives an empty result. Columns besides the two ends are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkbom.session import cut, drop_cut


def containment_links(edges: DataFrame) -> DataFrame:
    """``(parent, child)``, one row per child, of the edge rows whose kind says that the source holds the target."""
    kind = F.upper(F.trim("kind"))
    return (
        edges.where(kind.startswith("AST_") & F.col("source").isNotNull() & F.col("target").isNotNull())
        .groupBy(F.col("target").alias("child"))
        .agg(F.min("source").alias("parent"))
    )


def _numbered(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nid, id)`` of every id, and ``(nid, pid)`` of every link. Numbers replace long ids in all rounds; they grow with the ids (by
    bytes), so that siblings are in the order of their ids."""
    links = links.where("parent is not null and child is not null").groupBy("child").agg(F.min("parent").alias("parent"))
    links = cut(links, "links")
    ids = links.select(F.col("child").alias("id")).union(links.select("parent")).distinct()
    ids = cut(ids.sort("id").select(F.monotonically_increasing_id().alias("nid"), "id"), "ids")
    child, parent = ids.select(F.col("nid"), F.col("id").alias("child")), ids.select(F.col("nid").alias("pid"), F.col("id").alias("parent"))
    pairs = links.join(child, "child").join(parent, "parent").select("nid", "pid")
    return ids, pairs


def _cycles(stuck: DataFrame, ids: DataFrame) -> DataFrame:
    """``(nid, cycle_id)``: for nodes without a root, the smallest id on the cycle that their chain of parents enters.

    Pointers double until the set of nodes pointed at no longer shrinks (these are the nodes on cycles) and the smallest
    id seen from them no longer changes (it is then the smallest of the whole cycle)."""
    state = cut(stuck.join(ids, "nid").select("nid", F.col("pid").alias("ptr"), F.col("id").alias("low")), "cycle")
    before = -1
    while True:
        to = state.select(F.col("nid").alias("ptr"), F.col("ptr").alias("far"), F.col("low").alias("far_low"))
        # low covers the nodes before ptr, so far_low is the next stretch
        new = cut(state.join(to, "ptr").select("nid", F.col("far").alias("ptr"), F.least("low", "far_low").alias("low"), (F.col("far_low") < F.col("low")).alias("moved")), "cycle")
        held = new.select(F.col("ptr").alias("nid")).distinct()
        moved, on_cycle = new.join(held, "nid", "left_semi").agg(F.sum(F.col("moved").cast("int")), F.count("*")).first()
        drop_cut(state)
        state = new.drop("moved")
        state._shared_path = new._shared_path
        if on_cycle == before and not moved:
            break
        before = on_cycle
    low = state.select(F.col("nid").alias("ptr"), F.col("low").alias("cycle_id"))
    return state.select("nid", "ptr").join(low, "ptr").select("nid", "cycle_id")


def hierarchy(links: DataFrame, paths: bool = False, ranges: bool = True) -> DataFrame:
    """Rows ``(parent, child)`` to ``(node_id, parent_id, root_id, depth, size[, first, last][, path])``, one row per id.

    size: nodes of the subtree, itself included. first..last: preorder range within the tree of root_id; d is a descendant
    of a exactly if both have the same root and a.first < d.first <= a.last. path: the ids from the root down, as an array.
    On a cycle or behind one: depth -1, root_id the smallest id (by bytes) of that cycle, null size, range and path.
    """
    ids, pairs = _numbered(links)
    start = ids.join(pairs, "nid", "left").select(
        "nid", "pid", F.coalesce("pid", "nid").alias("ptr"), F.when(F.col("pid").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.lit(1).cast("long").alias("size")
    )
    start = cut(start, "tree")

    # up: pointers, distances and subtree sizes
    state, reach, last_active = start.select("nid", "ptr", "dist", "size"), 1, -1
    own = None
    while True:
        active = state.where(F.col("dist") == reach)
        n = active.count()
        if n == 0 or n == last_active:
            break
        last_active = n
        given = active.groupBy(F.col("ptr").alias("nid")).agg(F.sum("size").alias("more"))
        to = state.select(F.col("nid").alias("ptr"), F.col("ptr").alias("far"), F.col("dist").alias("add"))
        moved = active.join(to, "ptr").select("nid", F.col("far").alias("ptr"), (F.col("dist") + F.col("add")).alias("dist"), "size")
        new = moved.unionByName(state.where(F.col("dist") < reach)).join(given, "nid", "left")
        new = cut(new.select("nid", "ptr", "dist", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "up")
        if own is not None:
            drop_cut(own)
        own = state = new
        reach *= 2
    stuck = state.where(F.col("dist") == reach).select("nid") if n else None

    rooted = state.where(F.col("dist") < reach) if n else state
    tree = rooted.join(start.select("nid", "pid"), "nid")
    if not (ranges or paths):
        return _named(tree.select("nid", "pid", F.col("ptr").alias("root"), F.col("dist").alias("depth"), "size"), stuck, start, ids, ["size"], [])
    tree = cut(tree.select("nid", "pid", "size"), "tree")

    # siblings: offsets by prefix sums, in two steps so that the children of one parent need not share a task
    part = F.shiftright("nid", 33)
    kids = tree.where("pid is not null").select("nid", "pid", "size", part.alias("part"))
    sums = kids.groupBy("pid", "part").agg(F.sum("size").alias("all"))
    earlier = Window.partitionBy("pid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("pid", "part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))
    before = Window.partitionBy("pid", "part").orderBy("nid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kids.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0))).join(sums, ["pid", "part"])
    offsets = offsets.select("nid", (F.col("base") + F.col("at") + 1).alias("off"))

    # down: roots, depths, preorder numbers, and paths where wanted, along the same pointers
    down = tree.select("nid", F.coalesce("pid", "nid").alias("ptr"), F.when(F.col("pid").isNull(), 0).otherwise(1).cast("long").alias("dist")).join(offsets, "nid", "left")
    down = down.withColumn("off", F.coalesce("off", F.lit(0)))
    if paths:
        down = down.join(ids, "nid").select("nid", "ptr", "dist", "off", F.array("id").alias("path"))
    down = cut(down, "down")
    # the way up ended where no node with a root was as deep as its last reach
    depths, reach = reach, 1
    keep = ["path"] if paths else []
    while reach < depths:
        active = down.where(F.col("dist") == reach)
        to = down.select(F.col("nid").alias("ptr"), F.col("ptr").alias("far"), F.col("dist").alias("add"), F.col("off").alias("up"), *(F.col(c).alias("head") for c in keep))
        moved = active.join(to, "ptr").select(
            "nid", F.col("far").alias("ptr"), (F.col("dist") + F.col("add")).alias("dist"), (F.col("off") + F.col("up")).alias("off"), *(F.concat("head", "path").alias("path") for c in keep)
        )
        new = cut(moved.unionByName(down.where(F.col("dist") < reach)), "down")
        drop_cut(down)
        down = new
        reach *= 2

    down = down.select("nid", F.col("ptr").alias("root"), F.col("dist").alias("depth"), F.col("off").alias("first"), *keep)
    out = tree.join(down, "nid").withColumn("last", F.col("first") + F.col("size") - 1)
    return _named(out, stuck, start, ids, ["size", "first", "last"], keep)


def _named(tree: DataFrame, stuck: DataFrame | None, start: DataFrame, ids: DataFrame, numbers: list[str], keep: list[str]) -> DataFrame:
    """Numbers back to ids, and the nodes without a root added."""
    out = tree.join(ids, "nid").withColumnRenamed("id", "node_id")
    out = out.join(ids.select(F.col("nid").alias("root"), F.col("id").alias("root_id")), "root")
    out = out.join(ids.select(F.col("nid").alias("pid"), F.col("id").alias("parent_id")), "pid", "left")
    # a path's head is the root only for nodes below it
    path = [F.when(F.col("depth") == 0, F.array("node_id")).when(F.col("path")[0] == F.col("root_id"), F.col("path")).otherwise(F.concat(F.array("root_id"), F.col("path"))).alias("path")] if keep else []
    out = out.select("node_id", "parent_id", "root_id", F.col("depth").cast("int").alias("depth"), *numbers, *path)
    if stuck is None:
        return out
    lost = _cycles(stuck.join(start.select("nid", "pid"), "nid"), ids)
    lost = lost.join(start.select("nid", "pid"), "nid").join(ids, "nid").join(ids.select(F.col("nid").alias("pid"), F.col("id").alias("parent_id")), "pid")
    none = F.lit(None).cast("array<string>").alias("path")
    lost = lost.select(F.col("id").alias("node_id"), "parent_id", F.col("cycle_id").alias("root_id"), F.lit(-1).alias("depth"), *(F.lit(None).cast("long").alias(c) for c in numbers), *([none] if keep else []))
    return out.unionByName(lost)


#: Preorder places that one key of the join below holds at most, as a power of two.
BLOCK = 12


def descendants(tree: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``(ancestor_id, node_id, below)``: all descendants of the nodes ``of`` (a table with a column node_id; all nodes if it is missing),
    found by their preorder ranges within the same root. below: levels between the two.

    A range of up to 2^k places meets the blocks of 2^k places that it touches, k at most BLOCK; nodes have a row for each k. So the rows
    that meet are at most three times those that belong together, and no key holds more than 2^BLOCK nodes however large a tree is."""
    tree = tree.where("depth >= 0")
    a = tree if of is None else tree.join(of.select("node_id").distinct(), "node_id", "left_semi")
    a = a.where("last > first").select("root_id", F.col("node_id").alias("ancestor_id"), F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("depth").alias("top"))
    a = a.withColumn("k", F.least(F.lit(BLOCK), F.floor(F.log2(F.col("hi") - F.col("lo")))).cast("int"))
    a = a.withColumn("block", F.explode(F.expr("sequence(shiftright(lo + 1, k), shiftright(hi, k))")))
    d = tree.where("depth > 0").select("root_id", "node_id", "first", "depth", F.explode(F.sequence(F.lit(0), F.lit(BLOCK))).alias("k"))
    d = d.withColumn("block", F.expr("shiftright(first, k)"))
    return d.join(a, ["root_id", "k", "block"]).where("first > lo and first <= hi").select("ancestor_id", "node_id", (F.col("depth") - F.col("top")).alias("below"))
