"""Normalized graphs as JSON documents: reading them into node and edge rows, and writing rows back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH = "backend string, root string, nodes array<struct<id string, kind string, name string, file string, line int, function string, properties string>>, edges array<struct<source string, target string, kind string>>"


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """One row per document; a broken one has its text in ``_corrupt_record`` and nulls elsewhere. Properties stay JSON text."""
    schema = GRAPH.replace("struct<id string", "struct<id: string").replace("struct<source string", "struct<source: string")
    fields = spark.sql(f"SELECT from_json('', '{schema}, _corrupt_record string') AS g").schema["g"].dataType
    return spark.read.schema(fields).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def node_rows(graphs: DataFrame) -> DataFrame:
    return graphs.select("root", "backend", F.posexplode("nodes").alias("seq", "n")).select("root", "backend", "seq", "n.*")


def edge_rows(graphs: DataFrame) -> DataFrame:
    return graphs.select("root", F.posexplode("edges").alias("seq", "e")).select("root", "seq", "e.*")


def graph_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(root, file, document)``: one JSON document per file, so that none grows with a repository."""
    n = nodes.groupBy("root", "file").agg(F.sort_array(F.collect_list(F.struct("id", "kind", "name", "line", "function"))).alias("nodes"))
    ids = nodes.select(F.col("id").alias("source"), "root", "file")
    e = edges.select("source", "target", "kind").join(ids, "source").groupBy("root", "file").agg(F.sort_array(F.collect_list(F.struct("source", "target", "kind"))).alias("edges"))
    return n.join(e, ["root", "file"], "left").select("root", "file", F.to_json(F.struct("root", "nodes", F.coalesce("edges", F.array().cast("array<struct<source:string,target:string,kind:string>>")).alias("edges")), {"ignoreNullFields": "false"}).alias("document"))
