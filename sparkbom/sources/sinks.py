"""Writers: documents as JSON lines, drawings as DOT text, tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_documents(docs: DataFrame, path: str, column: str = "document") -> None:
    """One JSON document per line, partitioned by root, so that writing and re-reading one root touches nothing else."""
    docs.select("root", F.col(column).alias("value")).write.partitionBy("root").mode("overwrite").text(path)


def write_dot(lines: DataFrame, path: str) -> None:
    """One folder per root whose files, read in the order of their names, are one drawing. Lines are range-partitioned by root and part,
    so that a large repository fills many files."""
    ordered = lines.repartitionByRange("root", "part", "line").sortWithinPartitions("root", "part", "line")
    ordered.select("root", F.col("line").alias("value")).write.partitionBy("root").mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
