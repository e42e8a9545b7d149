"""Lines of text files with their true numbers, however the files are split for reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of every line.

    A piece of a file is read in order, so a line's place in it follows from its distance to the
    piece's first line; the pieces' line counts, a row for each, give what comes before.
    """
    meta = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_block_start")]
    read = spark.read.text(path).select("value", *meta, F.monotonically_increasing_id().alias("_id"))
    pieces = read.groupBy("file_path", "file_block_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    out = read.join(F.broadcast(pieces), ["file_path", "file_block_start"])  # a row for each piece that is read
    return out.select(F.col("file_path").alias("file"), (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")
