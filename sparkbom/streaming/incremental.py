"""Incremental scans: a stream of source files of which each version counts once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbom.session import shared_dir


def versions(stream: DataFrame) -> DataFrame:
    """(root, file, sha256) of what can be read: of a table each once, of a stream as it comes, to be made distinct batch by batch."""
    one = stream.where("content is not null").select("root", "file", F.sha2("content", 256).alias("sha256"))
    return one if one.isStreaming else one.dropDuplicates(["root", "file", "sha256"])


def scan_stream(spark: SparkSession, sf_dir: str, name: str = "source_files", base: str | None = None) -> DataFrame:
    """Reads a table's files as a stream until none is left and returns the versions that arrived. Progress and results stand in the
    folder ``base``: a call with the same folder goes on where the last one stopped and adds what has come since. Without one a new
    folder in the shared one is taken, and the call reads everything.

    Each batch is deduplicated and joined against the versions written before, so no state is kept in memory; a batch that is
    repeated after a failure writes its own part again."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    single = any(p.rstrip("/").endswith(f"/{name}.parquet") for p in table.inputFiles())
    reader = spark.readStream.schema(table.schema)
    stream = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if single else reader.parquet(f"{sf_dir}/{name}.parquet")
    base = base or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = "root string, file string, sha256 string, batch long"
    spark.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(f"{base}/out")

    def add(batch: DataFrame, number: int) -> None:
        key = ["root", "file", "sha256"]
        before = spark.read.schema(schema).parquet(f"{base}/out").where(F.col("batch") < number)
        batch = batch.dropDuplicates(key)
        same = [batch[k].eqNullSafe(before[k]) for k in key]
        new = batch.join(before, same, "left_anti")
        new.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = versions(stream).writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out").drop("batch")
