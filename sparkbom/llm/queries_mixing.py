"""Queries on mixes of sources (p7_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbom.llm import mixing as M
from sparkbom.session import cut, table


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Every document of the mix and how often it is used."""
    return M.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def _report(spark: SparkSession, sf: str, **how: object) -> DataFrame:
    used, plan, sizes = M.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), **how)
    return M.report(cut(used, "mix"), plan, sizes)


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted and reached shares of :func:`p7_mix`."""
    return _report(spark, sf)


def p7_double(spark: SparkSession, sf: str) -> DataFrame:
    """A mix of all tokens there are: limits bind, so the exponent is bisected to them."""
    return _report(spark, sf, total=1e18)


def p7_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """A mix that is as even as the targets are, whichever sources they name: token shares raised to one power."""
    return _report(spark, sf, match_entropy=True)


def p7_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Which sources of documents have a target: the part that SQL can check."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.lower(F.trim("source")).alias("source"))
    targets = table(spark, sf, "mix_targets").select(F.lower(F.trim("source")).alias("source"), "target_share")
    return docs.groupBy("source").agg(F.count_distinct("doc_id").alias("documents")).join(F.broadcast(targets), "source", "full")


QUERIES = {f.__name__: f for f in (p7_mix, p7_shares, p7_double, p7_entropy, p7_sources)}
SQL = {
    "p7_sources": """SELECT coalesce(d.source, t.source) AS source, d.documents, t.target_share FROM
(SELECT lower(trim(source)) AS source, count(DISTINCT doc_id) AS documents FROM documents WHERE text IS NOT NULL GROUP BY 1) d
FULL JOIN (SELECT lower(trim(source)) AS source, target_share FROM mix_targets) t ON d.source = t.source"""
}
