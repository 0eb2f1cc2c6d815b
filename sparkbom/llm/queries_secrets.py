"""Queries on embedded credentials (p5_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbom.llm import secrets as S
from sparkbom.session import cut, table


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return S.find(table(spark, sf, "source_files"), table(spark, sf, "nodes"), table(spark, sf, "findings"))


def p5_owners(spark: SparkSession, sf: str) -> DataFrame:
    """How many literals are owned by how many repositories, by the strength of their strongest context."""
    index = S.literal_index(S.places(*(table(spark, sf, t) for t in ("source_files", "nodes", "findings"))))
    return index.groupBy("owners", "strength").agg(F.count("*").alias("literals"))


def p5_steps(spark: SparkSession, sf: str) -> DataFrame:
    """What each step of the method leaves."""
    return S.steps(*(table(spark, sf, t) for t in ("source_files", "nodes", "findings")))


def p5_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every string of files, nodes and findings that holds a credential of any of them, masked; files still parse like the originals."""
    tables = [table(spark, sf, t) for t in ("source_files", "nodes", "findings")]
    found = cut(S.find(*tables), "found")
    return S.redact(S.fields(found, *tables), found)


QUERIES = {f.__name__: f for f in (p5_found, p5_owners, p5_steps, p5_redacted)}
SQL: dict[str, str] = {}
