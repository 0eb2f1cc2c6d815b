import datetime as dt
import json

from sparkbom.operators import schema_drift as D

SCHEMA = "cbom_id long, root string, source string, file_name string, generated_at timestamp_ntz, received_at timestamp_ntz, payload string, field string"


def docs(spark, rows):
    t = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, "r", s, "f", None if n is None else t + dt.timedelta(days=n), t, p if p is None or isinstance(p, str) else json.dumps(p), "clash") for i, s, n, p in rows], SCHEMA)


def doc(assets, **top):
    return {"spec_version": "1.0", "metadata": {"tool": "t", "run": "run-11"}, "cryptographic_assets": assets} | top


def found(spark, rows):
    return {tuple(r) for r in D.changes(docs(spark, rows)).select("cbom_id", "field", "change", "new_field").collect()}


def test_kinds_of_change(spark):
    one = doc([{"asset_id": "a", "context": {"line": 3, "file": "x"}, "tags": ["q"], "old": "v1"}, {"asset_id": "b", "context": {"line": 4, "file": None}, "old": "v2"}])
    two = doc([{"asset_id": "b", "context": {"lineno": 4, "file": "unknown"}, "tags": "q", "new": "z"}, {"asset_id": "a", "context": {"lineno": 3, "file": "x"}, "tags": "w", "new": "y"}], summary={"n": 1})
    three = doc([{"asset_id": "a", "context": {"lineno": 9, "file": "y"}, "tags": None, "new": "w"}])
    four = doc([{"asset_id": "a", "context": {"lineno": 9, "file": "y"}, "new": "w"}])
    three["metadata"] = {"tool": "t", "job": "run-97"}
    four["metadata"] = three["metadata"]
    p = "cryptographic_assets."
    rows = [(1, "s", 1, one), (2, "s", 2, two), (2, "s", 2, two), (3, "s", 3, three), (4, "s", 4, four)]
    assert found(spark, rows) == {
        (2, p + "context.line", "renamed", p + "context.lineno"), (2, p + "tags", "retyped", ""), (2, p + "old", "removed", ""), (2, p + "new", "added", ""), (3, "metadata.run", "renamed", "metadata.job"),
    }


def test_bad_rows_and_types(spark):
    rows = [(1, "s", 1, {"v": 1}), (2, "s", 2, "no json"), (3, "s", 3, None), (4, "s", 4, {"v": 1.5}), (5, "s", None, {"w": 1}), (6, None, 1, {"w": 1}), (7, "t", 1, {"w": True}), (8, "t", 2, {"w": 1}), (9, "t", 3, "[1]")]
    assert found(spark, rows) == {(4, "v", "retyped", ""), (8, "w", "retyped", "")}
    assert {r.cbom_id for r in D.unreadable(docs(spark, rows)).collect()} >= {2, 3, 9}
    assert D.changes(docs(spark, [])).count() == 0


def test_consistent_table(spark):
    rows = [(i, "s", i, doc([{"asset_id": "a", "n": i, "k": "v"}])) for i in range(1, 5)] + [(9, "s", 9, doc([{"asset_id": "a", "n": "many", "key": "v"}]))]
    out = D.consistent_table(docs(spark, rows)).collect()
    assert {(r.cbom_id, r.n, r.k, tuple(r.failed_casts)) for r in out} == {(1, 1, "v", ()), (2, 2, "v", ()), (3, 3, "v", ()), (4, 4, "v", ()), (9, None, "v", ("n",))}
    assert D.consistent_table(docs(spark, [])).count() == 0


def test_long_source_is_spread_over_partitions(spark):
    rows = [(i, "hot", i, {"v": i if i % 7 else "x"}) for i in range(1, 300)]
    leaves = D.path_values(docs(spark, rows))
    follows = {tuple(r) for r in D.successors(leaves).collect()}
    assert follows == {(i, i + 1) for i in range(1, 299)}


def test_table_holds_documents_and_every_element(spark):
    rows = [(i, "s", i, doc([{"asset_id": "a", "n": 1}, {"asset_id": "a", "n": 2}, {}], level=i)) for i in (1, 2)]
    rows += [(3, "s", 3, doc([], level="high", spec_version="2.0")), (4, "t", 1, {"level": 4, "cryptographic_assets": None}), (5, "t", 2, "no json")]
    out = D.consistent_table(docs(spark, rows)).collect()
    got = {(r.cbom_id, r.position, r.asset_id, r.n, r.document_level, r.document_spec_version, r.document_metadata_tool, tuple(r.failed_casts)) for r in out}
    want = {(i, k, "a" if k < 2 else None, k + 1 if k < 2 else None, i, "1.0", "t", ()) for i in (1, 2) for k in (0, 1, 2)}
    assert got == want | {(3, None, None, None, None, "2.0", "t", ("document_level",)), (4, None, None, None, 4, None, None, ())} and len(out) == 8


def test_table_holds_what_is_not_compared(spark):
    art = [{"asset_id": "x", "n": 7, "new": "only here"}, {"asset_id": "x", "n": "many"}]
    rows = [(i, "s", i, doc([{"asset_id": "a", "n": 1}], supporting_artifacts=art, summary={"total": i, "by": {"AES": 2, "aes": 3}})) for i in (1, 2)]
    rows += [(3, None, 3, doc([], summary={"total": 3})), (4, "s", None, doc([], supporting_artifacts=[{"n": 4}]))]
    table = D.consistent_table(docs(spark, rows))
    got = {(r.cbom_id, r.list, r.position, r.asset_id, r.n, r.new, r.document_summary_total, r.document_summary_by_AES, tuple(r.failed_casts)) for r in table.collect()}
    a, s = "cryptographic_assets", "supporting_artifacts"
    want = {(i, a, 0, "a", 1, None, i, 2, ()) for i in (1, 2)}
    want |= {(i, s, 0, "x", 7, "only here", i, 2, ()) for i in (1, 2)} | {(i, s, 1, "x", None, None, i, 2, ("n",)) for i in (1, 2)}
    assert got == want | {(3, None, None, None, None, None, 3, None, ()), (4, s, 0, None, 4, None, None, None, ())}
    assert "document_summary_by_aes_" in table.columns and table.count() == 8
    assert found(spark, rows) == set()
