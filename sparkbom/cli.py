"""``python -m sparkbom.cli scan|exchange|graph|summary --source FOLDER --out FOLDER``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkbom.operators import documents, graph, match, signals
from sparkbom.session import cut, release
from sparkbom.sources import python_source, sinks


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkbom")
    parser.add_argument("command", choices=("scan", "exchange", "graph", "summary"))
    parser.add_argument("--source", required=True)
    parser.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("sparkbom").getOrCreate()
    rows = cut(python_source.parse(python_source.source_tree(spark, args.source)), "rows")
    nodes = cut(python_source.nodes(rows), "nodes")
    edges = python_source.containment(rows).unionByName(graph.resolve_calls(nodes).withColumn("kind", F.lit("CALLS")))
    edges = cut(edges.join(nodes.select(F.col("id").alias("source"), "root").distinct(), "source"), "edges")
    if args.command == "scan":
        sinks.write_documents(documents.bills(documents.full_assets(nodes, edges)), args.out)
    elif args.command == "exchange":
        sinks.write_documents(documents.exchange(documents.full_assets(nodes, edges)), args.out)
    elif args.command == "graph":
        sinks.write_dot(graph.dot_lines(nodes, edges), args.out)
    else:
        signals.assets(cut(match.matched(nodes), "matched"), nodes, edges).groupBy("root", "algorithm", "risk").agg(F.count("*").alias("assets")).write.mode("overwrite").parquet(args.out)
    release(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
