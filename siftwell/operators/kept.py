"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="siftwell-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the folder of spark.checkpoint.dir, and read again; a folder of our own only where everything runs in one process.

    The table is removed when the driver ends.
    """
    path = _place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, columns: list[str], buckets: int, name: str = "table") -> DataFrame:
    """As kept, in buckets by the columns: joins and groups by them with as many partitions move no row of it.

    It is a table of the session's catalog until dropped; its files go as those of kept do.
    """
    spark = df.sparkSession
    path = _place(spark, name)
    table = "siftwell_" + path.rpartition("/")[2].replace("-", "_")
    df.repartition(buckets, *columns).write.format("parquet").bucketBy(buckets, *columns).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._table, out._path = table, path
    return out


def dropped(df: DataFrame, files: bool = True) -> None:
    """Takes a table of bucketed out of the catalog, and its files unless something reads them still."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {df._table}")
    if files:
        at = spark._jvm.org.apache.hadoop.fs.Path(df._path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
