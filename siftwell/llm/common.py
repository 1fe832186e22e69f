"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one of the given tables; sf_dir may be any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's spark.checkpoint.dir; only where that is unset and
    everything runs in one process, as in tests, a folder of our own is made and
    set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="siftwell-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts lineage, survives lost executors.

    The table is removed when the driver ends, if discard does not remove it before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that materialize wrote, once all that read them is written itself."""
    for df in tables:
        if path := getattr(df, "_written", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fold_of(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; null keys take the remainder of the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def quoted(df: DataFrame) -> list[str]:
    """The columns' names so that dots in them are no paths."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """A column name like name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name
