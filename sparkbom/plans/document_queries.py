"""Queries on sources, documents and increments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbom.operators import documents as D
from sparkbom.operators import graph as G
from sparkbom.operators import match as M
from sparkbom.operators import signals as S
from sparkbom.plans.match_sql import FULL, RISK
from sparkbom.session import cut, table
from sparkbom.sources import graph_json as J
from sparkbom.sources import python_source as P
from sparkbom.streaming import incremental as I

#: Calls that the line scan knows: the reference's list in its order, which decides between several on a line, then further ones.
KNOWN = (
    "AES.new", "PKCS1_OAEP.new", "RSA.generate", "hashlib.sha256", "hashlib.sha1", "hashlib.md5", "hashlib.pbkdf2_hmac", "hmac.new", "Fernet.generate_key", "Fernet", "secrets.token_bytes", "os.urandom", "random.randbytes",
    "Cipher", "random.randint", "jwt.encode", "jwt.decode",
)


def _m(spark: SparkSession, sf: str) -> DataFrame:
    return M.matched(table(spark, sf, "nodes"))


def _full(spark: SparkSession, sf: str) -> DataFrame:
    return D.full_assets(table(spark, sf, "nodes"), table(spark, sf, "edges"))


def bill_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Assets, supporting artifacts and ignored calls of each file's bill."""
    kind = lambda k: F.count_if(F.col("asset_class") == k).cast("int")
    return _m(spark, sf).groupBy("root", "file").agg(kind("primary_asset").alias("assets"), kind("supporting_artifact").alias("supporting"), kind("ignore").alias("ignored"))


def bill_json(spark: SparkSession, sf: str) -> DataFrame:
    """The documents themselves."""
    return D.bills(_full(spark, sf)).select("root", "file", "document")


def exchange_json(spark: SparkSession, sf: str) -> DataFrame:
    """The exchange documents."""
    return D.exchange(_full(spark, sf))


def graph_context(spark: SparkSession, sf: str) -> DataFrame:
    """Edges in and out of each matched call, and callers and callees of its function."""
    nodes, edges = table(spark, sf, "nodes"), table(spark, sf, "edges")
    counts = D.call_counts(G.call_graph(nodes, edges)).withColumnRenamed("fn", "function")
    m = M.matched(nodes).select("id", "root", "function").join(counts, ["root", "function"], "left").join(D.edge_facts(edges), "id", "left").fillna(0, ["callers", "callees", "incoming", "outgoing"])
    return m.select("id", "callers", "callees", "incoming", "outgoing", F.coalesce(F.array_join("edge_kinds", ","), F.lit("")).alias("edge_kinds"))


def exchange_components(spark: SparkSession, sf: str) -> DataFrame:
    return D.components(_m(spark, sf))


def provider_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return D.dependencies(_m(spark, sf))


def run_manifest(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = table(spark, sf, "nodes"), table(spark, sf, "edges")
    return D.manifest(S.assets(cut(M.matched(nodes), "matched"), nodes, edges), nodes, edges)


def file_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return D.fingerprints(table(spark, sf, "source_files"))


def incremental_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Files that had arrived by the middle of the year against all files."""
    files = table(spark, sf, "source_files")
    return D.changes(D.fingerprints(files.where("loaded_at < timestamp_ntz '2025-07-01 00:00:00'")), D.fingerprints(files))


def stream_versions(spark: SparkSession, sf: str) -> DataFrame:
    return I.scan_stream(spark, sf).groupBy("root").agg(F.count("*").alias("versions"))


def latest_artifact(spark: SparkSession, sf: str) -> DataFrame:
    return D.latest(table(spark, sf, "cbom_files")).select("source", "cbom_id")


def confidence_average(spark: SparkSession, sf: str) -> DataFrame:
    """Mean confidence of the assets in the newest document of each source; values that are no numbers do not count."""
    docs = D.latest(table(spark, sf, "cbom_files"))
    a = docs.select("source", F.explode(F.from_json(F.get_json_object("payload", "$.cryptographic_assets"), "array<struct<risk:struct<confidence:string>>>")).alias("a"))
    return a.groupBy("source").agg(F.round(F.avg(F.col("a.risk.confidence").try_cast("double")), 6).alias("confidence"), F.count("*").alias("assets"))


def pruned_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "cbom_files").select("cbom_id", "payload").dropDuplicates(["cbom_id"])
    return D.pruned(docs)


def boundary_scan(spark: SparkSession, sf: str) -> DataFrame:
    return P.boundary_scan(table(spark, sf, "source_files"), KNOWN)


def python_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by kind that the parser makes of the Python files."""
    return P.parse(table(spark, sf, "source_files")).groupBy("root", "what").agg(F.count("*").alias("n"))


def python_assignments(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut(P.parse(table(spark, sf, "source_files")), "rows")
    return P.resolve(rows).where("assigned is not null")


def python_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Source text to matched calls: parse, resolve imports, match."""
    return M.described(M.with_arguments(M.first_matches(P.calls(P.parse(table(spark, sf, "source_files")))))).groupBy("api", "algorithm", "mode").agg(F.count("*").alias("n"))


def graph_documents(spark: SparkSession, sf: str) -> DataFrame:
    from sparkbom.operators.graph import nodes_of

    return J.graph_documents(nodes_of(table(spark, sf, "nodes"), "root", "file", "kind", "name", "line", "function"), table(spark, sf, "edges").where("source is not null")).select("root", "file", F.length("document").alias("chars"))


def finding_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Findings as they were recorded, counted once each in one pass."""
    f = table(spark, sf, "findings").select("finding_id", F.col("risk"), F.upper("algorithm").alias("algorithm"), F.coalesce("provider", F.lit("unknown")).alias("provider")).dropDuplicates(["finding_id"])
    return spark.sql("SELECT risk, algorithm, provider, count(*) AS n FROM {f} GROUP BY GROUPING SETS ((risk), (algorithm), (provider), ())", f=f)


def findings_to_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Findings against their nodes; lost nodes leave nulls."""
    n = G.nodes_of(table(spark, sf, "nodes"), "kind").select(F.col("id").alias("node_id"), "kind")
    f = table(spark, sf, "findings").dropDuplicates(["finding_id"])
    return f.join(n, "node_id", "left").groupBy("api_name", "kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (bill_documents, bill_json, exchange_json, graph_context, exchange_components, provider_dependencies, run_manifest, file_fingerprint, incremental_diff, stream_versions, latest_artifact, confidence_average, pruned_documents, boundary_scan, python_parse, python_assignments, python_matches, graph_documents, finding_summary, findings_to_nodes)}

_FP = "SELECT DISTINCT root, file, sha256(content) AS sha256, CAST(strlen(content) AS BIGINT) AS bytes FROM source_files WHERE content IS NOT NULL"
_LATEST = "SELECT source, arg_max(cbom_id, (generated_at, cbom_id)) AS cbom_id, arg_max(payload, (generated_at, cbom_id)) AS payload FROM cbom_files GROUP BY source"
_FIRST = "CASE " + " ".join(f"WHEN contains(text, '{k}(') THEN '{k}'" for k in KNOWN) + " END"
SQL = {
    "bill_documents": FULL + " SELECT root, file, CAST(count(*) FILTER (asset_class = 'primary_asset') AS INTEGER) AS assets, CAST(count(*) FILTER (asset_class = 'supporting_artifact') AS INTEGER) AS supporting, CAST(count(*) FILTER (asset_class = 'ignore') AS INTEGER) AS ignored FROM m GROUP BY 1, 2",
    "graph_context": FULL + """, nn AS (SELECT DISTINCT root, id, coalesce(function, name) AS fn FROM nodes WHERE id IS NOT NULL AND name IS NOT NULL),
g AS (SELECT DISTINCT a.root, a.fn AS caller, b.fn AS callee FROM edges e JOIN nn a ON a.id = e.source JOIN nn b ON b.id = e.target AND b.root = a.root WHERE upper(trim(e.kind)) = 'CALLS' AND a.fn <> b.fn),
ee AS (SELECT source AS id, 0 AS i, 1 AS o, upper(trim(kind)) AS kind FROM edges WHERE source IS NOT NULL UNION ALL SELECT target, 1, 0, upper(trim(kind)) FROM edges WHERE target IS NOT NULL),
ef AS (SELECT id, sum(i) AS i, sum(o) AS o, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM ee GROUP BY id)
SELECT m.id, coalesce(r.n, 0) AS callers, coalesce(c.n, 0) AS callees, CAST(coalesce(ef.i, 0) AS BIGINT) AS incoming, CAST(coalesce(ef.o, 0) AS BIGINT) AS outgoing, coalesce(kinds, '') AS edge_kinds FROM m LEFT JOIN ef ON ef.id = m.id
LEFT JOIN (SELECT root, callee, count(*) AS n FROM g GROUP BY 1, 2) r ON r.root = m.root AND r.callee = m.function LEFT JOIN (SELECT root, caller, count(*) AS n FROM g GROUP BY 1, 2) c ON c.root = m.root AND c.caller = m.function""",
    "exchange_components": FULL + """ SELECT root, id AS ref, 'cryptographic-asset' AS type, algorithm AS name, CASE WHEN mode IS NOT NULL AND mode <> 'unknown' THEN mode WHEN key_size <> 'unknown' THEN 'key_size:' || key_size END AS parameter_set,
CASE operation WHEN 'encryption' THEN 'encrypt' WHEN 'decryption' THEN 'decrypt' WHEN 'hashing' THEN 'digest' WHEN 'key_derivation' THEN 'derive' WHEN 'key_generation' THEN 'generate' WHEN 'random_generation' THEN 'generate' WHEN 'authentication' THEN 'authenticate' WHEN 'signing' THEN 'sign' WHEN 'verification' THEN 'verify' ELSE operation END AS function FROM m WHERE asset_class = 'primary_asset'
UNION ALL SELECT DISTINCT root, 'crypto-provider:' || replace(lower(provider), ' ', '-'), 'library', provider, NULL, NULL FROM m WHERE asset_class = 'primary_asset' AND provider IS NOT NULL""",
    "provider_dependencies": FULL + """ SELECT root, id AS ref, 'crypto-provider:' || replace(lower(provider), ' ', '-') AS depends_on FROM m WHERE asset_class = 'primary_asset'
UNION ALL SELECT DISTINCT root, 'crypto-provider:' || replace(lower(provider), ' ', '-'), NULL FROM m WHERE asset_class = 'primary_asset' AND provider IS NOT NULL""",
    "run_manifest": RISK + """, n AS (SELECT root, count(*) AS nodes FROM nodes GROUP BY 1), e AS (SELECT root, count(*) AS edges FROM edges GROUP BY 1), a AS (SELECT root, count(*) AS assets, count(*) FILTER (risk IN ('high', 'critical')) AS high FROM r GROUP BY 1)
SELECT root, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges, coalesce(assets, 0) AS assets, coalesce(high, 0) AS high FROM n FULL JOIN e USING (root) FULL JOIN a USING (root)""",
    "file_fingerprint": _FP,
    "incremental_diff": f"""WITH b AS ({_FP} AND loaded_at < TIMESTAMP '2025-07-01'), a AS ({_FP})
SELECT coalesce(a.root, b.root) AS root, coalesce(a.file, b.file) AS file, CASE WHEN b.sha256 IS NULL THEN 'added' WHEN a.sha256 IS NULL THEN 'removed' WHEN a.sha256 = b.sha256 THEN 'unchanged' ELSE 'modified' END AS change FROM b FULL JOIN a ON a.root = b.root AND a.file = b.file""",
    "stream_versions": "SELECT root, count(*) AS versions FROM (SELECT DISTINCT root, file, sha256(content) FROM source_files WHERE content IS NOT NULL) GROUP BY root",
    "latest_artifact": f"SELECT source, cbom_id FROM ({_LATEST})",
    "confidence_average": f"""SELECT source, round(avg(TRY_CAST(a ->> '$.risk.confidence' AS DOUBLE)), 6) AS confidence, count(*) AS assets FROM (SELECT source, unnest(CAST(json_extract(payload, '$.cryptographic_assets') AS JSON[])) AS a FROM ({_LATEST})) GROUP BY source""",
    "boundary_scan": rf"""WITH f AS (SELECT DISTINCT root, file, content FROM source_files WHERE content IS NOT NULL AND lower(file) LIKE '%.py'),
l AS (SELECT root, file, string_split_regex(content, '\r\n|\r|\n') AS lines FROM f), p AS (SELECT root, file, unnest(range(len(lines))) AS pos, lines FROM l), t AS (SELECT root, file, pos, lines[pos + 1] AS text FROM p),
d AS (SELECT *, nullif(regexp_extract(text, '^\s*(?:async\s+)?def\s+(\w+)\s*\(', 1), '') AS def, {_FIRST} AS api FROM t),
w AS (SELECT *, last_value(def IGNORE NULLS) OVER (PARTITION BY root, file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS function FROM d)
SELECT root, file, CAST(pos + 1 AS INTEGER) AS line, function, api FROM w WHERE api IS NOT NULL""",
    "finding_summary": """SELECT risk, algorithm, provider, count(*) AS n FROM (SELECT DISTINCT finding_id, risk, upper(algorithm) AS algorithm, coalesce(provider, 'unknown') AS provider FROM findings)
GROUP BY GROUPING SETS ((risk), (algorithm), (provider), ())""",
    "findings_to_nodes": """SELECT f.api_name, n.kind, count(*) AS n FROM (SELECT DISTINCT finding_id, api_name, node_id FROM findings) f LEFT JOIN (SELECT DISTINCT id, lower(trim(kind)) AS kind FROM nodes WHERE id IS NOT NULL) n ON n.id = f.node_id GROUP BY 1, 2""",
}
