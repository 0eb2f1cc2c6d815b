"""Queries on matched calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbom.operators import explain as E
from sparkbom.operators import graph as G
from sparkbom.operators import match as M
from sparkbom.operators import signals as S
from sparkbom.plans.match_sql import SQL  # noqa: F401
from sparkbom.session import cut, table


def _m(spark: SparkSession, sf: str) -> DataFrame:
    return M.matched(table(spark, sf, "nodes"))


def _assets(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "nodes")
    return S.assets(cut(M.matched(nodes), "matched"), nodes, table(spark, sf, "edges"))


def match_api(spark: SparkSession, sf: str) -> DataFrame:
    return M.matches(G.calls_of(table(spark, sf, "nodes")))


def match_api_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return M.first_matches(G.calls_of(table(spark, sf, "nodes"))).select("id", "api", "algorithm", "primitive", "provider")


def unmatched_calls_anti(spark: SparkSession, sf: str) -> DataFrame:
    return M.unmatched(G.calls_of(table(spark, sf, "nodes"))).groupBy("name").agg(F.count("*").alias("n"))


def normalized_algorithms(spark: SparkSession, sf: str) -> DataFrame:
    """What each call really uses, whatever wrapper it goes through."""
    return _m(spark, sf).select("id", "api", "algorithm", "primitive", "provider", "mode", "padding", "key_size", "operation", F.array_join("evidence", "; ").alias("evidence"))


def summary_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Five counts in one pass over the assets."""
    m = _assets(spark, sf).where("asset_class = 'primary_asset'").select("risk", "primitive", "algorithm", F.coalesce("provider", F.lit("unknown")).alias("provider"), "operation")
    return spark.sql("SELECT risk, primitive, algorithm, provider, operation, count(*) AS n FROM {m} GROUP BY GROUPING SETS ((risk), (primitive), (algorithm), (provider), (operation), ())", m=m)


def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _m(spark, sf).groupBy("asset_class", "primitive", "class_reason").agg(F.count("*").alias("n"))


def call_details(spark: SparkSession, sf: str) -> DataFrame:
    """Mode, padding, digest, curve, key size, iterations and operation of every matched call."""
    return _m(spark, sf).select("id", "mode", "padding", "digest", "curve", "key_size", "iterations", "operation")


def argument_signals(spark: SparkSession, sf: str) -> DataFrame:
    """What each argument is for and what is known of its value."""
    nodes = table(spark, sf, "nodes")
    s = S.argument_signals(M.matched(nodes), nodes)
    return s.select("id", "index", "role", "semantic_value", "is_literal", "literal_origin", "origin_kind", "origin_expression", "mode", "padding", "key_size")


def flow_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Where key, data, vector, nonce, salt and randomness of each call come from, and where its output goes."""
    nodes = table(spark, sf, "nodes")
    f = S.flow_sources(cut(M.matched(nodes), "matched"), nodes, table(spark, sf, "edges"))
    return f.select("id", *(f"{r}_source" for r in ("key", "data", "iv", "nonce", "salt", "randomness")), "sink_type", "sink_id", "hardcoded", F.array_join("classes", ",").alias("classes"))


def risk_full(spark: SparkSession, sf: str) -> DataFrame:
    return _assets(spark, sf).select("id", "risk", F.concat_ws(",", "tags").alias("tags"), F.round("confidence", 2).alias("confidence"))


def max_risk_fold(spark: SparkSession, sf: str) -> DataFrame:
    return _assets(spark, sf).groupBy("root", "file").agg(F.max_by("risk", M.rank(F.col("risk"))).alias("risk"), F.count("*").alias("assets"))


def rule_match_v2(spark: SparkSession, sf: str) -> DataFrame:
    return M.rule_matches(_m(spark, sf)).select("id", "rule_id", "explanation")


def rule_match_v1(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of the first profile: the rules in their order and the highest of their risks."""
    m = _m(spark, sf)
    hit = M.rule_matches_v1(m).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "rule_id"))).alias("r"), F.max_by("risk", M.rank(F.col("risk"))).alias("risk"))
    rules = F.array_join(F.transform("r", lambda x: x["rule_id"]), ",")
    return m.select("id").join(hit, "id", "left").select("id", F.coalesce(rules, F.lit("")).alias("rules"), F.coalesce("risk", F.lit("info")).alias("risk"))


def summary_v1(spark: SparkSession, sf: str) -> DataFrame:
    """Calls by rule and by risk of the first profile."""
    return M.rule_matches_v1(_m(spark, sf)).groupBy("rule_id", "risk").agg(F.count("*").alias("n"))


def rule_priority_sort(spark: SparkSession, sf: str) -> DataFrame:
    r = M.rule_matches(_m(spark, sf)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "seq", "rule_id"))).alias("r"))
    return r.select("id", F.array_join(F.transform("r", lambda x: x["rule_id"]), ",").alias("rules"))


def rule_group(spark: SparkSession, sf: str) -> DataFrame:
    r = M.rule_matches(_m(spark, sf))
    return r.groupBy(M.rule_group(F.col("priority"), F.col("actionable")).alias("bucket"), "rule_id").agg(F.count("*").alias("n"))


def source_label_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of data per argument, by the words in it."""
    a = _m(spark, sf).select("id", F.posexplode("args").alias("index", "argument"))
    a = a.select("id", "index", F.lower("argument").alias("low"))
    return a.select("id", "index", F.explode(S.classes_of(S.source_mask(F.col("low")))).alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def sink_first_match(spark: SparkSession, sf: str) -> DataFrame:
    return _m(spark, sf).groupBy("primitive", M.sink_of(F.col("primitive")).alias("sink")).agg(F.count("*").alias("n"))


def argument_roles(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "nodes")
    return S.argument_signals(M.matched(nodes), nodes).groupBy("api", "index", "role").agg(F.count("*").alias("n"))


def argument_origins(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "nodes")
    return S.argument_signals(M.matched(nodes), nodes).groupBy("origin_kind", "literal_origin").agg(F.count("*").alias("n"), F.count_distinct("semantic_value").alias("texts"))


def usage_explanations(spark: SparkSession, sf: str) -> DataFrame:
    """The explained context and intent of every call, with the callers above it."""
    nodes = table(spark, sf, "nodes")
    chains = G.longest_chains(G.call_graph(nodes, table(spark, sf, "edges")))
    m = E.with_chains(M.matched(nodes), chains)
    m = m.select("id", E.usage_context().alias("u"), E.intent().alias("i"), E.usage_intent().alias("stated"))
    return m.select("id", F.col("u.value").alias("context"), F.col("u.method").alias("context_method"), F.col("u.confidence").alias("context_confidence"), F.col("i.value").alias("intent"), F.col("i.method").alias("intent_method"), F.col("i.confidence").alias("intent_confidence"), F.array_join(F.concat("u.evidence", "i.evidence"), "; ").alias("evidence"), "stated")


def first_three_args(spark: SparkSession, sf: str) -> DataFrame:
    return _m(spark, sf).select("id", F.array_join(F.slice("args", 1, 3), " | ").alias("args"))


def asset_id_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Stable ids of an asset and of its place."""
    line, function = F.coalesce(F.col("line").cast("string"), F.lit("None")), F.coalesce("function", F.lit(""))
    asset = F.concat_ws("|", "api", "file", line, function, "id")
    node = F.concat_ws("|", "file", line, function, "api")
    return _m(spark, sf).select("id", F.concat(F.lit("crypto-"), F.substring(F.sha2(asset, 256), 1, 16)).alias("asset_id"), F.concat(F.lit("n_"), F.substring(F.sha2(node, 256), 1, 12)).alias("node_ref"))


def function_panel(spark: SparkSession, sf: str) -> DataFrame:
    return _assets(spark, sf).groupBy("root", F.coalesce("function", F.lit("module_level")).alias("function")).agg(F.count("*").alias("crypto_calls"), F.count_distinct("algorithm").alias("algorithms"), F.count_if(F.col("risk").isin("high", "critical")).alias("high"))


def provider_components(spark: SparkSession, sf: str) -> DataFrame:
    m = _m(spark, sf).where("asset_class = 'primary_asset'")
    return m.groupBy("root").agg(F.array_join(F.sort_array(F.collect_set("provider")), ",").alias("providers"), F.count("*").alias("assets"))


QUERIES = {
    f.__name__: f
    for f in (
        match_api, match_api_first_wins, unmatched_calls_anti, normalized_algorithms, summary_grouping_sets, class_counts, call_details, argument_signals, flow_sources, risk_full, max_risk_fold, rule_match_v2, rule_match_v1,
        summary_v1, rule_priority_sort, rule_group, source_label_classify, sink_first_match, argument_roles, argument_origins, usage_explanations, first_three_args, asset_id_hash, function_panel, provider_components,
    )
}
