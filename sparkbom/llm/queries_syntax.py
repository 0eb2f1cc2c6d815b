"""Queries on files that do not parse (p1_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkbom.llm import syntax
from sparkbom.session import cut, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.parse_status(table(spark, sf, "source_files")).where("status = 'broken'").select("file_id")


def p1_status(spark: SparkSession, sf: str) -> DataFrame:
    """The first unrecoverable error of every broken file."""
    return syntax.parse_status(table(spark, sf, "source_files")).where("status = 'broken'")


def p1_rates(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.rates(cut(syntax.parse_status(table(spark, sf, "source_files")), "status"))


def p1_json(spark: SparkSession, sf: str) -> DataFrame:
    """Broken json files alone: the part that SQL can check."""
    return syntax.parse_status(table(spark, sf, "source_files").where("lower(file) like '%.json'")).where("status = 'broken'").select("file_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_status, p1_rates, p1_json)}
SQL = {"p1_json": "SELECT DISTINCT file_id FROM source_files WHERE lower(file) LIKE '%.json' AND content IS NOT NULL AND NOT json_valid(content)"}
