import json

from sparkbom import cli
from sparkbom.sources import graph_json as J


def test_scan_graph_and_summary(spark, tmp_path):
    src = tmp_path / "src"
    (src / "pkg" / ".hidden").mkdir(parents=True)
    (src / "pkg" / "a.py").write_text("import hashlib\n\n\ndef f(x):\n    return hashlib.md5(x).digest()\n")
    (src / "pkg" / "bad.py").write_text("def (")
    (src / "pkg" / ".hidden" / "b.py").write_text("import hashlib\nhashlib.sha1(b'')\n")
    for command in ("scan", "exchange", "graph", "summary"):
        assert cli.main([command, "--source", str(src), "--out", str(tmp_path / command)]) == 0
    docs = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "scan")).collect()]
    assert len(docs) == 1 and docs[0]["cryptographic_assets"][0]["risk"]["level"] == "high" and docs[0]["cryptographic_assets"][0]["crypto_metadata"]["padding"] is None
    only = docs[0]["cryptographic_assets"][0]
    assert only["usage"] == {"operation": "digest", "intent": "compute_hash_digest"} and [r["id"] for r in only["rules"]] == ["DEPRECATED_HASH"] and only["context"]["call_chain"] == ["a.f"]
    assert only["flow"]["data_source"] == "function_parameter" and only["flow"]["key_source"] is None and docs[0]["summary"]["by_algorithm"] == {"MD5": 1}
    bom = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "exchange")).collect()][0]
    assert [c["type"] for c in bom["components"]] == ["cryptographic-asset", "library"] and bom["dependencies"][0] == {"ref": only["asset_id"], "dependsOn": ["crypto-provider:python-stdlib"]}
    assert bom["components"][0]["cryptoProperties"]["algorithmProperties"] == {"cryptoFunctions": ["digest"], "primitive": "hash"} and "key_source" not in bom["components"][0]["analysis"]["flow"]
    lines = [r.value for r in spark.read.text(str(tmp_path / "graph")).collect()]
    assert sum("->" in x for x in lines) == 2 and len(lines) == 7 and lines[0] == "digraph G {" and lines[-1] == "}"
    assert [(r.algorithm, r.risk, r.assets) for r in spark.read.parquet(str(tmp_path / "summary")).collect()] == [("MD5", "high", 1)]


def test_graph_json_round_trip(spark, tmp_path):
    doc = {"backend": "b", "root": "/r", "nodes": [{"id": "1", "kind": "call", "name": None, "file": "f", "line": 2, "function": None, "properties": "{}"}], "edges": [{"source": "1", "target": "2", "kind": "DFG"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text("{nope")
    graphs = J.read_graphs(spark, str(tmp_path / "*.json"))
    assert [r.id for r in J.node_rows(graphs).collect()] == ["1"] and J.edge_rows(graphs).count() == 1
    assert [r._corrupt_record for r in graphs.collect() if r.nodes is None] == ["{nope"]
    out = J.graph_documents(J.node_rows(graphs), J.edge_rows(graphs)).collect()
    assert json.loads(out[0].document)["edges"] == [{"source": "1", "target": "2", "kind": "DFG"}]
