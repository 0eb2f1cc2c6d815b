"""Queries on files that are not hand-written (p4_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbom.llm import origin as O
from sparkbom.session import cut, table


def _origins(spark: SparkSession, sf: str) -> DataFrame:
    return O.origins(table(spark, sf, "source_files"), table(spark, sf, "upstream_files"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _origins(spark, sf).select("file_id").distinct()


def p4_origins(spark: SparkSession, sf: str) -> DataFrame:
    return _origins(spark, sf).groupBy("root", "origin", "reason").agg(F.count("*").alias("files"))


def p4_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings in hand-written files only."""
    return O.handwritten(table(spark, sf, "findings"), cut(_origins(spark, sf), "origins")).groupBy("algorithm").agg(F.count_distinct("finding_id").alias("findings"))


QUERIES = {f.__name__: f for f in (p4_found, p4_origins, p4_findings)}
SQL: dict[str, str] = {}
