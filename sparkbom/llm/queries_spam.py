"""Queries on keyword-stuffed and link-list pages (p8_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbom.llm import spam_pages as S
from sparkbom.session import cut, table


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return S.spam_pages(table(spark, sf, "documents")).select("doc_id").distinct()


def p8_curves(spark: SparkSession, sf: str) -> DataFrame:
    """The rank-frequency line of every page, without the language model: the part that SQL can check."""
    return S.curves(table(spark, sf, "documents")).select("doc_id", "words", F.round("slope", 4).alias("slope"))


def p8_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Per language and class of length: pages, pages that their curves flag, and those that the last check keeps."""
    docs = table(spark, sf, "documents")
    model = S.models_of(docs)
    pages = cut(S.curves(docs, model), "pages")
    flagged = S.unusual(pages).select("doc_id", F.lit(1).alias("flagged")).dropDuplicates(["doc_id"])
    kept = S.spam_pages(docs).select("doc_id", F.lit(1).alias("kept")).dropDuplicates(["doc_id"])
    all_ = pages.join(flagged, "doc_id", "left").join(kept, "doc_id", "left")
    return all_.groupBy("model", "size").agg(F.count("*").alias("pages"), F.count("flagged").alias("flagged"), F.count("kept").alias("kept"))


QUERIES = {f.__name__: f for f in (p8_found, p8_curves, p8_steps)}
SQL = {
    "p8_curves": r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS word FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY doc_id, word),
r AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM c)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS words, round(coalesce(regr_slope(ln(n), ln(rank)), 0), 4) AS slope FROM r GROUP BY doc_id"""
}
