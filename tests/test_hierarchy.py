import random

from sparkbom.operators.hierarchy import containment_links, descendants, hierarchy

EDGES = "root string, source string, target string, kind string, size string"


def brute(pairs):
    up = {}
    for p, c in pairs:
        if p is not None and c is not None:
            up[c] = min(p, up.get(c, p))
    out = {}
    for x in {*up, *up.values()}:
        path = [x]
        while path[-1] in up and up[path[-1]] not in path:
            path.append(up[path[-1]])
        if path[-1] in up:
            cycle = path[path.index(up[path[-1]]) :]
            out[x] = (-1, min(cycle), None)
        else:
            out[x] = (len(path) - 1, path[-1], path[::-1])
    return out


def run(spark, pairs, paths=True):
    df = spark.createDataFrame(pairs, "parent string, child string")
    return {r.node_id: r for r in hierarchy(df, paths).collect()}


def test_random_forest_with_cycles_and_a_deep_chain(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(i)}", f"n{i}") for i in range(1, 60)] + [(f"d{i}", f"d{i + 1}") for i in range(70)]
    pairs += [("c2", "c0"), ("c0", "c1"), ("c1", "c2"), ("c1", "tail"), ("tail", "tail2"), ("self", "self"), ("self", "x"), ("hub", "n0")]
    pairs += [("hub", f"k{i}") for i in range(30)] + pairs[:5] + [(None, "n3"), ("n4", None)]
    got, want = run(spark, pairs), brute(pairs)
    assert {k: (r.depth, r.root_id, r.path) for k, r in got.items()} == want
    for k, r in got.items():
        if r.depth >= 0:
            below = [x for x, w in want.items() if w[2] and k in w[2]]
            assert r.size == len(below) and r.last - r.first + 1 == r.size
            assert {x for x in below} == {x for x, o in got.items() if o.depth >= 0 and o.root_id == r.root_id and r.first <= o.first <= r.last}


def test_descendants(spark):
    tree = hierarchy(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d")], "parent string, child string"))
    got = {tuple(r) for r in descendants(tree, spark.createDataFrame([("a",), ("b",), ("b",)], "node_id string")).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)}


def test_descendants_of_all_nodes_in_small_blocks(spark, monkeypatch):
    from sparkbom.operators import hierarchy as H

    rng = random.Random(8)
    pairs = [(f"n{rng.randrange(max(0, i - 9), i)}", f"n{i}") for i in range(1, 120)] + [("hub", f"k{i}") for i in range(50)] + [("c1", "c2"), ("c2", "c1")]
    tree = hierarchy(spark.createDataFrame(pairs, "parent string, child string"))
    want = {(a, x, len(w[2]) - 1 - w[2].index(a)) for x, w in brute(pairs).items() if w[2] for a in w[2][:-1]}
    for block in (12, 2):
        monkeypatch.setattr(H, "BLOCK", block)
        got = [tuple(r) for r in descendants(tree).collect()]
        assert set(got) == want and len(got) == len(want)
    plain = hierarchy(spark.createDataFrame(pairs, "parent string, child string"), ranges=False)
    assert {tuple(r) for r in plain.select("node_id", "root_id", "depth").collect()} == {tuple(r) for r in tree.select("node_id", "root_id", "depth").collect()} and "first" not in plain.columns


def test_empty_nulls_and_kinds(spark):
    assert hierarchy(spark.createDataFrame([], "parent string, child string")).count() == 0
    rows = [("r", "a", "b", " ast_Function ", "1"), ("r", "a", "b", "AST_FUNCTION", "1"), ("r", None, "c", "AST_CALLEE", "1"), ("r", "a", "d", "CALLS", "1"), ("r", "b", "e", None, "1"), ("r", "b", "f", "AST_ARGUMENT_1", None)]
    links = containment_links(spark.createDataFrame(rows, EDGES))
    assert {tuple(r) for r in links.select("parent", "child").collect()} == {("a", "b"), ("b", "f")}


def test_only_cycles(spark):
    got = run(spark, [("b", "a"), ("a", "b")], False)
    assert {(k, r.depth, r.root_id) for k, r in got.items()} == {("a", -1, "a"), ("b", -1, "a")}


def test_p2_found_goes_up_and_down(spark, tmp_path):
    from sparkbom.plans.problems import p2_found

    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(max(0, i - 5), i)}", f"n{i}") for i in range(1, 90)] + [("c1", "c2"), ("c2", "c1"), ("c2", "tail")] + [("hub", f"k{i}") for i in range(40)]
    spark.createDataFrame([("r", a, b, "AST_BODY", "1") for a, b in pairs], EDGES).write.parquet(str(tmp_path / "edges.parquet"))
    out = p2_found(spark, str(tmp_path))
    assert {(r.node_id, r.root_id, r.depth) for r in out.collect()} == {(k, w[1], w[0]) for k, w in brute(pairs).items()}
    read = {f.rsplit("/", 2)[1].split("-")[0] for f in out.inputFiles()}
    assert {"tree", "down"} <= read  # roots and depths are those of the way down
