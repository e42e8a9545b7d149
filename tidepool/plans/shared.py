"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

#: Columns that are written without looking each text up among those before it, where a table has them.
LONG_TEXTS = ("body", "state.excerpt")
_local: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder of the setting spark.checkpoint.dir, or the one set on the context."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="tidepool-plans-"))
    return _local[0]


def materialised(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df below the shared folder, in partitions of a column if asked for, and read it again.

    Only a session in one process may go without a shared folder; it gets a temporary one.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in LONG_TEXTS})
    (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that materialised() made, once nothing reads it any more."""
    spark = df.sparkSession
    paths = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(df._jdf.queryExecution().analyzed().collectLeaves())
    for leaf in paths:
        for root in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(leaf.relation().location().rootPaths()):
            root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
