"""Table access and the one way in which this library cuts a plan's lineage."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir`` of the session, or, where that is unset (tests), a
    fresh temporary folder that is then set as the session's checkpoint folder. On a cluster an unset folder is an error."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = folder or tempfile.mkdtemp(prefix="spark-shared-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, name: str = "step", *by: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder, one folder per value of ``by``, and reads it back: the plan starts anew from
    files that outlive any executor, and the result is computed once however often it is used."""
    spark = df.sparkSession
    ship(spark)
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    spark.sparkContext._cut_paths = [*getattr(spark.sparkContext, "_cut_paths", []), path]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_cut(df: DataFrame) -> None:
    """Removes a table that :func:`cut` wrote, once nothing reads it any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Removes all tables that :func:`cut` wrote in this session. Results that have not been read to their end need them: call this
    when a job is done."""
    for path in getattr(spark.sparkContext, "_cut_paths", []):
        _delete(spark, path)
    spark.sparkContext._cut_paths = []


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitions rows for steps whose work per byte is high: at least four tasks per core, and no fewer than
    ``spark.sql.shuffle.partitions``, which grows with the data."""
    spark = df.sparkSession
    ship(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per session, unless ``PYTHONPATH`` already holds it for every worker."""
    package = Path(__file__).resolve().parent
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_shipped_package", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))  # Spark serves the archive to every executor
    spark.sparkContext._shipped_package = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, preceded by :func:`ship`."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
