"""Bills of materials as documents, their exchange form, manifests, and reading them back.

A document covers one file of one root, so collecting its assets is bounded by the file. Null means not applicable and the
text ``unknown`` means not resolved; both survive into JSON and are pruned only in the exchange form.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbom.functions import dims
from sparkbom.operators import explain as E
from sparkbom.operators import graph as G
from sparkbom.operators import match as M
from sparkbom.operators import signals as S
from sparkbom.session import cut

KEEP_NULLS = {"ignoreNullFields": "false"}
PLACEHOLDERS = ("", "unknown", "unknown_file", "unknown_function")


def edge_facts(edges: DataFrame) -> DataFrame:
    """``(id, incoming, outgoing, edge_kinds)`` of every node; the kinds of edges are few."""
    ends = F.explode(F.array(F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"))))
    e = edges.select(F.upper(F.trim("kind")).alias("kind"), ends.alias("e")).select("kind", "e.*").where("id is not null")
    by = e.groupBy("id", "kind").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))  # partial sums first
    return by.groupBy("id").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"), F.array_sort(F.collect_set("kind")).alias("edge_kinds"))


def call_counts(pairs: DataFrame) -> DataFrame:
    """``(root, fn, callers, callees)`` of ``(root, caller, callee)``."""
    ends = F.explode(F.array(F.struct(F.col("caller").alias("fn"), F.lit(0).alias("r"), F.lit(1).alias("e")), F.struct(F.col("callee").alias("fn"), F.lit(1).alias("r"), F.lit(0).alias("e"))))
    return pairs.select("root", ends.alias("x")).select("root", "x.*").groupBy("root", "fn").agg(F.sum("r").alias("callers"), F.sum("e").alias("callees"))


def full_assets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Everything that a bill says of an asset, one row per matched call."""
    pairs = cut(G.call_graph(nodes, edges), "calls")
    m = S.assets(cut(M.matched(nodes), "matched"), nodes, edges)
    m = E.with_chains(m, G.longest_chains(pairs)).join(call_counts(pairs).withColumnRenamed("fn", "function"), ["root", "function"], "left").join(edge_facts(edges), "id", "left").fillna(0, ["callers", "callees", "incoming", "outgoing"])
    r = M.rule_matches(m).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "seq", "rule_id", "message", "priority", "actionable", "explanation"))).alias("rules"))
    return E.explained(m).join(r, "id", "left")


def asset() -> Column:
    """An asset with its thirteen groups."""
    c, t = F.col, F.lit
    file = F.coalesce(F.nullif(F.trim("file"), t("")), t("unknown_file"))
    named = lambda f: F.coalesce(F.nullif(F.trim(f), t("")), F.when(file == "unknown_file", "unknown_function").otherwise("module_level"))
    line, function = F.coalesce(c("line").cast("string"), t("None")), F.coalesce("function", t(""))
    hashed = lambda head, n, *parts: F.concat(t(head), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, n))
    rules = F.transform(F.coalesce("rules", F.array()), lambda r: F.struct(r["rule_id"].alias("id"), r["message"].alias("message"), r["priority"].alias("priority"), r["actionable"].alias("actionable"), r["explanation"].alias("explanation")))
    return F.struct(
        hashed("crypto-", 16, "api", F.coalesce("file", t("")), line, function, "id").alias("asset_id"), "asset_class", c("class_reason").alias("asset_class_reason"),
        F.struct("algorithm", "primitive", "mode", "padding", F.coalesce("provider", t("unknown")).alias("provider"), "key_size").alias("crypto_metadata"),
        F.struct("operation", c("usage_intent").alias("intent")).alias("usage"),
        F.struct(file.alias("file"), named(c("function")).alias("function"), "line", F.transform("chain", named).alias("call_chain")).alias("context"),
        F.struct(*(f"{r}_source" for r in ("key", "data", "iv", "nonce", "salt", "randomness")), F.struct(c("sink_type").alias("type"), c("sink_id").alias("id")).alias("sink")).alias("flow"),
        F.struct(t("direct").alias("execution_path"), t(None).cast("string").alias("branch_condition"), t(False).alias("inside_loop"), t(False).alias("guarded_by_condition")).alias("control"),
        F.struct(F.size("chain").alias("call_depth"), ((c("callers") > 0) | (c("callees") > 0)).alias("cross_function_flow"), (c("incoming") + c("outgoing")).alias("dataflow_steps"), F.coalesce("edge_kinds", F.array().cast("array<string>")).alias("edge_kinds")).alias("graph_context"),
        F.struct(c("risk").alias("level"), F.round("confidence", 3).alias("confidence"), "tags").alias("risk"), rules.alias("rules"),
        F.struct("usage_context", "intent", "data_flow", "derivation_path").alias("inference"),
        F.struct(
            F.struct(c("api").alias("api_call"), "resolved_name", "callee", F.slice("args", 1, 3).alias("arguments"), c("evidence").alias("normalization")).alias("summary"),
            F.struct(
                hashed("n_", 12, F.coalesce("file", t("")), line, function, "api").alias("node_ref"), F.concat(F.coalesce("file", t("")), t(":"), F.coalesce(c("line").cast("string"), t("unknown"))).alias("location_ref"),
                c("id").alias("raw_node_id"), c("args").alias("full_arguments"), F.struct(c("incoming").alias("incoming_count"), c("outgoing").alias("outgoing_count"), "edge_kinds").alias("graph_edges_summary"),
            ).alias("debug"),
        ).alias("evidence"),
    )


def bills(m: DataFrame) -> DataFrame:
    """``(root, file, assets, supporting, ignored, document)`` per file with matched calls, of :func:`full_assets`."""
    kind = lambda k: F.array_sort(F.collect_list(F.when(F.col("asset_class") == k, F.col("asset"))), _by_id)
    g = m.select("root", "file", "asset_class", asset().alias("asset")).groupBy("root", "file").agg(
        kind("primary_asset").alias("cryptographic_assets"), kind("supporting_artifact").alias("supporting_artifacts"), F.count_if(F.col("asset_class") == "ignore").alias("ignored")
    )
    count = lambda path: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.expr(f"transform(cryptographic_assets, a -> a.{path})"))), lambda k: F.struct(k, F.size(F.filter(F.expr(f"transform(cryptographic_assets, a -> a.{path})"), lambda v: v == k)))))
    by = {"by_risk": "risk.level", "by_primitive": "crypto_metadata.primitive", "by_algorithm": "crypto_metadata.algorithm", "by_provider": "crypto_metadata.provider", "by_operation": "usage.operation"}
    summary = F.struct(F.size("cryptographic_assets").alias("total_assets"), F.size("supporting_artifacts").alias("supporting_artifacts"), F.col("ignored").alias("ignored_findings"), *(count(p).alias(k) for k, p in by.items()))
    metadata = F.struct(F.concat_ws("/", "root", "file").alias("source"), F.lit("python").alias("source_language"))
    doc = F.struct(F.lit("1.0").alias("spec_version"), metadata.alias("metadata"), "cryptographic_assets", "supporting_artifacts", summary.alias("summary"))
    return g.select("root", "file", F.size("cryptographic_assets").alias("assets"), F.size("supporting_artifacts").alias("supporting"), F.col("ignored").cast("int").alias("ignored"), F.to_json(doc, KEEP_NULLS).alias("document"))


def _by_id(a: Column, b: Column) -> Column:
    x, y = a["asset_id"], b["asset_id"]
    return F.when(a.isNull() | b.isNull(), F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), 1).otherwise(-1)).when(x < y, -1).when(x > y, 1).otherwise(0)


def parameter_set(mode: Column, key_size: Column) -> Column:
    """A known mode, else a known key size."""
    return F.when(mode.isNotNull() & (mode != "unknown"), mode).when(key_size.isNotNull() & (key_size != "unknown"), F.concat(F.lit("key_size:"), key_size))


def crypto_function(operation: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in dims.FUNCTIONS.items() for x in kv)), operation), operation)


def provider_ref(provider: Column) -> Column:
    return F.concat(F.lit("crypto-provider:"), F.replace(F.lower(provider), F.lit(" "), F.lit("-")))


def components(m: DataFrame) -> DataFrame:
    """Assets and providers as components of one bill: ``(root, ref, type, name, parameter_set, function)``."""
    a = m.where("asset_class = 'primary_asset'").select("root", F.col("id").alias("ref"), F.lit("cryptographic-asset").alias("type"), F.col("algorithm").alias("name"), parameter_set(F.col("mode"), F.col("key_size")).alias("parameter_set"), crypto_function(F.col("operation")).alias("function"))
    p = m.where("asset_class = 'primary_asset' and provider is not null").select("root", provider_ref(F.col("provider")).alias("ref"), F.lit("library").alias("type"), F.col("provider").alias("name"), F.lit(None).cast("string").alias("parameter_set"), F.lit(None).cast("string").alias("function")).distinct()
    return a.unionByName(p)


def dependencies(m: DataFrame) -> DataFrame:
    """``(root, ref, depends_on)``: each asset on its provider, and each provider on nothing."""
    primary = m.where("asset_class = 'primary_asset'")
    a = primary.select("root", F.col("id").alias("ref"), provider_ref(F.col("provider")).alias("depends_on"))
    return a.unionByName(primary.where("provider is not null").select("root", provider_ref(F.col("provider")).alias("ref"), F.lit(None).cast("string").alias("depends_on")).distinct())


def _told(value: Column) -> Column:
    """Null for texts that say nothing."""
    return F.when(~value.isin(*PLACEHOLDERS) & ~value.startswith("UNKNOWN."), value)


def _filled(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def exchange(m: DataFrame) -> DataFrame:
    """``(root, file, document)``: the exchange form of each file's primary assets, of :func:`full_assets`. Fields without content are
    left out. An asset without an id is referred to by its algorithm and place, which an asset of this library never is."""
    a = asset()
    one = m.where("asset_class = 'primary_asset'").select("root", "file", a.alias("a"))
    c = F.col
    algorithm = F.struct(F.array(crypto_function(c("a.usage.operation"))).alias("cryptoFunctions"), _told(c("a.crypto_metadata.primitive")).alias("primitive"), parameter_set(c("a.crypto_metadata.mode"), c("a.crypto_metadata.key_size")).alias("parameterSetIdentifier"))
    flow = F.struct(*(_told(c(f"a.flow.{r}_source")).alias(f"{r}_source") for r in ("key", "data", "iv", "nonce", "salt", "randomness")), F.struct(_told(c("a.flow.sink.type")).alias("type"), c("a.flow.sink.id").alias("id")).alias("sink"))
    context = F.struct(_told(c("a.context.file")).alias("file"), _told(c("a.context.function")).alias("function"), c("a.context.line").alias("line"), _filled(F.filter(c("a.context.call_chain"), lambda x: _told(x).isNotNull())).alias("call_chain"))
    graph = F.struct(c("a.graph_context.call_depth").alias("call_depth"), c("a.graph_context.cross_function_flow").alias("cross_function_flow"), c("a.graph_context.dataflow_steps").alias("dataflow_steps"), _filled(c("a.graph_context.edge_kinds")).alias("edge_kinds"))
    told = lambda x: F.struct(x["value"].alias("value"), x["method"].alias("method"), x["confidence"].alias("confidence"), _filled(x["evidence"]).alias("evidence"))
    flowing = F.struct(F.struct(_filled(c("a.inference.data_flow.value.input_sources")).alias("input_sources"), _told(c("a.inference.data_flow.value.output_destination")).alias("output_destination")).alias("value"), c("a.inference.data_flow.method").alias("method"), c("a.inference.data_flow.confidence").alias("confidence"), _filled(c("a.inference.data_flow.evidence")).alias("evidence"))
    summary = c("a.evidence.summary")
    evidence = F.struct(F.struct(summary["api_call"].alias("api_call"), _told(summary["resolved_name"]).alias("resolved_name"), _told(summary["callee"]).alias("callee"), _filled(summary["arguments"]).alias("arguments"), _filled(summary["normalization"]).alias("normalization")).alias("summary"))
    analysis = F.struct(
        context.alias("context"), flow.alias("flow"), F.struct(F.coalesce(c("a.risk.tags"), F.array().cast("array<string>")).alias("tags"), c("a.risk.level").alias("level"), c("a.risk.confidence").alias("confidence")).alias("risk"),
        F.struct(told(c("a.inference.usage_context")).alias("usage_context"), told(c("a.inference.intent")).alias("intent"), flowing.alias("data_flow"), told(c("a.inference.derivation_path")).alias("derivation_path")).alias("inference"),
        _filled(c("a.rules")).alias("rules"), graph.alias("graph_context"), evidence.alias("evidence"),
    )
    provider = _told(c("a.crypto_metadata.provider"))
    component = F.struct(
        F.lit("cryptographic-asset").alias("type"), F.coalesce(c("a.crypto_metadata.algorithm"), F.lit("unknown-algorithm")).alias("name"), c("a.asset_id").alias("bom-ref"),
        F.struct(F.lit("algorithm").alias("assetType"), algorithm.alias("algorithmProperties")).alias("cryptoProperties"), analysis.alias("analysis"),
        F.when(provider.isNotNull(), F.array(F.struct(F.lit("provider").alias("name"), provider.alias("value")))).alias("properties"),
    )
    depends = F.struct(c("a.asset_id").alias("ref"), F.when(provider.isNotNull(), F.array(provider_ref(provider))).otherwise(F.array().cast("array<string>")).alias("dependsOn"))
    by_ref = lambda x, y: F.when(x["bom-ref"] < y["bom-ref"], -1).when(x["bom-ref"] > y["bom-ref"], 1).otherwise(0)
    g = one.groupBy("root", "file").agg(F.array_sort(F.collect_list(component), by_ref).alias("assets"), F.array_sort(F.collect_list(depends)).alias("depends"), F.array_sort(F.collect_set(provider)).alias("providers"))
    library = F.transform("providers", lambda x: F.struct(F.lit("library").alias("type"), x.alias("name"), provider_ref(x).alias("bom-ref"), F.array(F.struct(F.lit("component_role").alias("name"), F.lit("crypto-provider").alias("value"))).alias("properties")))
    nothing = F.transform("providers", lambda x: F.struct(provider_ref(x).alias("ref"), F.array().cast("array<string>").alias("dependsOn")))
    metadata = F.struct(F.struct(F.lit("application").alias("type"), F.concat_ws("/", "root", "file").alias("name"), F.lit("1.0").alias("version")).alias("component"))
    # both kinds of components in one list: as texts, since their fields differ
    listed = F.concat(F.transform("assets", lambda x: F.to_json(x)), F.transform(library, lambda x: F.to_json(x)))
    text = F.concat(F.lit('{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"metadata":'), F.to_json(metadata), F.lit(',"components":['), F.array_join(listed, ","), F.lit('],"dependencies":'), F.to_json(F.concat("depends", nothing)), F.lit("}"))
    return g.select("root", "file", text.alias("document"))


def prune(value: object) -> object:
    """Drops nulls, placeholders and containers that are empty after that; keeps 0 and false."""
    if isinstance(value, dict):
        kept = {k: p for k, v in value.items() if (p := prune(v)) is not None}
        return kept or None
    if isinstance(value, list):
        return [p for v in value if (p := prune(v)) is not None] or None
    return None if value is None or value in PLACEHOLDERS and isinstance(value, str) else value


def pruned(docs: DataFrame, column: str = "payload") -> DataFrame:
    """Replaces JSON documents by their pruned form; null where the text is no JSON."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = []
            for text in part[column]:
                try:
                    done.append(json.dumps(prune(json.loads(text)), ensure_ascii=False))
                except (TypeError, ValueError):
                    done.append(None)
            yield part.assign(**{column: done})

    return docs.mapInPandas(run, docs.schema)


def manifest(m: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per root: nodes, edges, assets and assets at high risk."""
    n = nodes.groupBy("root").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("root").agg(F.count("*").alias("edges"))
    a = m.groupBy("root").agg(F.count("*").alias("assets"), F.count_if(F.col("risk").isin("high", "critical")).alias("high"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.join(e, "root", "full").join(a, "root", "full").select("root", *(zero(c) for c in ("nodes", "edges", "assets", "high")))


def fingerprints(files: DataFrame) -> DataFrame:
    return files.where("content is not null").select("root", "file", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes")).distinct()


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(root, file, change)`` of two fingerprint snapshots: added, removed, modified or unchanged."""
    b, a = before.select("root", "file", F.col("sha256").alias("was")), after.select("root", "file", F.col("sha256").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("modified")
    return b.join(a, ["root", "file"], "full").select("root", "file", change.alias("change"))


def latest(docs: DataFrame) -> DataFrame:
    """The newest document of each source, by time and then id."""
    order = F.struct("generated_at", "cbom_id")
    return docs.groupBy("source").agg(F.max_by("cbom_id", order).alias("cbom_id"), F.max_by("payload", order).alias("payload"))
