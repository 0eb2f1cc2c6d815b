import ast

import pytest

import __spark_entry__ as entry
from sparkbom.operators import documents as D
from sparkbom.operators import graph as G
from sparkbom.operators import match as M
from sparkbom.operators import signals as S
from sparkbom.plans import registry
from sparkbom.sources import python_source as P

CODE = "import hashlib as h\nfrom Crypto.Cipher import AES\n\n\ndef f(key, data):\n    salt = b'x'\n    c = AES.new(key, AES.MODE_ECB)\n    h.md5(data).hexdigest()\n    return g(salt, n=3)\n\n\ndef g(a, n=0):\n    return a\n"


def parsed(spark):
    return P.parse(spark.createDataFrame([("/r", "m.py", CODE), ("/r", "bad.py", "def ("), ("/r", "n.py", None), ("/r", "m.py", CODE)], "root string, file string, content string"))


def test_parser_rows(spark):
    rows = parsed(spark).collect()
    calls = {r["name"]: r for r in rows if r.what == "call"}
    assert calls["AES.new"].target == "Crypto.Cipher.AES.new" and calls["h.md5"].target == "hashlib.md5"
    assert calls["AES.new"].function == "m.f" and calls["g"].keywords == {"n": "3"}
    assert {r["name"] for r in rows if r.what == "function"} == {"m.f", "m.g"}
    assert P.containment(parsed(spark)).count() == len([r for r in rows if r.what == "call"])
    files = spark.createDataFrame([("/r", "m.py", CODE), ("/r", "bad.py", "def (")], "root string, file string, content string")
    assert [r.file for r in P.parse_errors(files).collect()] == ["bad.py"]
    assert {(r["name"], r.assigned) for r in P.resolve(parsed(spark)).collect() if r.assigned} == {("g", "b'x'")}
    ast.parse(CODE)


def test_match_and_risk(spark):
    rows = parsed(spark)
    nodes = P.nodes(rows)
    edges = P.containment(rows)
    m = {r.api: r for r in S.assets(M.matched(nodes), nodes, edges).collect()}
    assert m["AES.new"].risk == "critical" and m["AES.new"].mode == "ECB" and m["hashlib.md5"].risk == "high"


def test_prune_keeps_zero_and_is_idempotent():
    doc = {"a": None, "b": "unknown", "c": 0, "d": False, "e": {"f": ""}, "g": [None, "unknown_file"], "h": [1, {"i": None}]}
    assert D.prune(doc) == {"c": 0, "d": False, "h": [1]}
    assert D.prune(D.prune(doc)) == D.prune(doc)


def test_longest_chain_and_reach(spark):
    pairs = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "x", "c"), ("r", "c", "d"), ("r", "d", "c"), ("s", "q", "a")], "root string, caller string, callee string")
    got = {(r.root, r.fn): r.chain for r in G.longest_chains(pairs).collect()}
    assert got["r", "d"] == ["a", "b", "c", "d"] and got["r", "a"] == ["a"] and got["s", "a"] == ["q", "a"]
    edges = spark.createDataFrame([("1", "2", "dfg"), ("3", "2", "DFG "), ("3", "4", "CALLS"), (None, "1", "DFG")], "source string, target string, kind string")
    assert {tuple(r) for r in G.reach(edges, spark.createDataFrame([("1",)], "id string")).collect()} == {("1", "1", 0), ("1", "2", 1), ("1", "3", 2)}


def test_registry_is_consistent():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tables_are_released_and_streams_go_on(spark, tmp_path):
    import os

    from sparkbom import session
    from sparkbom.streaming import incremental as I

    one = session.cut(spark.range(3).toDF("x"), "kept")
    assert one.count() == 3 and os.path.isdir(one._shared_path.removeprefix("file:"))
    session.release(spark)
    assert not os.path.exists(one._shared_path.removeprefix("file:"))
    files = "file_id long, root string, file string, content string"
    add = lambda rows: spark.createDataFrame(rows, files).write.mode("append").parquet(f"{tmp_path}/source_files.parquet")
    add([(1, "r", "a.py", "x"), (1, "r", "a.py", "x"), (2, "r", None, "y"), (3, "r", "c.py", None)])
    versions = lambda: sorted((r.root, r.file or "", r.sha256[:4]) for r in I.scan_stream(spark, str(tmp_path), base=f"{tmp_path}/state").collect())
    first = versions()
    assert len(first) == 2
    add([(1, "r", "a.py", "x"), (4, "r", "a.py", "z")])
    assert len(versions()) == 3 and set(first) < set(versions())


def test_the_latest_row_wins(spark):
    rows = [("r", "1", "call", "old", "2025-01-01 00:00:00"), ("r", "1", "call", "new", "2025-03-01 00:00:00"), ("r", "1", "call", "mid", "2025-02-01 00:00:00"), ("r", "2", "call", "only", None)]
    nodes = spark.createDataFrame(rows, "root string, id string, kind string, name string, at string").selectExpr("root", "id", "kind", "name", "cast(at as timestamp_ntz) as loaded_at")
    assert {(r.id, r["name"]) for r in G.nodes_of(nodes).collect()} == {("1", "new"), ("2", "only")}


@pytest.mark.parametrize("name", ["match_api_first_wins", "degree", "rule_match_v2", "p2_ranges", "normalized_algorithms", "argument_signals", "flow_sources", "risk_full", "rule_match_v1", "graph_context", "longest_call_chain", "boundary_scan"])
def test_against_sql(spark, name):
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    db = duckdb.connect()
    for t in os.listdir(sf):
        db.execute(f"create view {t[:-8]} as select * from '{sf}/{t}'")
    df = registry.queries()[name](spark, sf)
    want = db.execute(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_boundary_scan_knows_the_calls_of_the_reference(spark, tmp_path):
    from sparkbom.plans.document_queries import boundary_scan

    calls = ["PKCS1_OAEP.new", "RSA.generate", "hashlib.pbkdf2_hmac", "Fernet.generate_key", "secrets.token_bytes", "random.randbytes", "jwt.encode"]
    text = "".join(f"x = {c}(a)\n" for c in calls) + "x = hashlib.md5(hashlib.sha256(a))\nx = Cipher(Fernet(a))\n"
    spark.createDataFrame([("/r", "a.py", text)], "root string, file string, content string").write.parquet(f"{tmp_path}/source_files.parquet")
    got = [r.api for r in boundary_scan(spark, str(tmp_path)).orderBy("line").collect()]
    assert got == [*calls, "hashlib.sha256", "Fernet"]
