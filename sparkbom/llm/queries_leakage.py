"""Queries on evaluation texts within documents (p6_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbom.llm.leakage import leaks
from sparkbom.session import cut, table


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).where("kind = 'passage'").select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    """How often, and in which sources, each leaked item stands in the corpus, and how often with its answer or as a paraphrase."""
    docs = table(spark, sf, "documents")
    found = cut(leaks(docs, table(spark, sf, "eval_items")), "leaks")
    source = docs.select("doc_id", F.lower(F.trim("source")).alias("source")).dropDuplicates(["doc_id"])
    return found.join(source, "doc_id").groupBy("item_id").agg(F.count_if(F.col("kind") == "passage").alias("documents"), F.count_if(F.col("kind") == "paraphrase").alias("paraphrases"), F.count_if("answer").alias("with_answer"), F.max("span").alias("longest"), F.sort_array(F.collect_set("source")).alias("sources"))


QUERIES = {f.__name__: f for f in (p6_found, p6_items)}
SQL: dict[str, str] = {}
