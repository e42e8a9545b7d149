"""Notes and records that arrive over time: each micro-batch is a wave of the same run.

What a run has learned of a key (a digest or a state's key) is in its committed rows, and every micro-batch
meets them: a key that an earlier one judged is served, not judged again. The keys are the state of the
stream; it is as durable as the journal, and a batch that is repeated after a failure counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidepool.plans.shared import drop, materialised
from tidepool.sources import sinks


def record_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of JSON files as they appear in a folder."""
    return spark.readStream.format("text").load(folder)


def journal_stream(spark: SparkSession, journal: str) -> DataFrame:
    """What is committed to a journal, a row for each wave, as it appears; read_wave() has a wave's rows."""
    return spark.readStream.schema(sinks.COMMIT).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(f"{journal}/commits")


def known(spark: SparkSession, journal: str, run_id: str, key: str) -> DataFrame | None:
    """The rows of a run that were judged themselves, one for each key; None if there are none yet."""
    rows = sinks.read_rows(spark, journal, run_id)
    if key not in rows.columns:
        return None
    return rows.filter(F.col("same_as").isNull()).drop("wave", "run_id")


def joined(batch: DataFrame, decide: Callable[[DataFrame], DataFrame], held: DataFrame | None, key: str = "key", path: str = "path", order: str = "plan_ord") -> DataFrame:
    """A row for every row of the batch: the first of each new key by `order` is decided, the others have its row.

    held: rows of earlier batches, one a key. Rows that share a key keep their own path and order, are
    cached and say whose row they have (same_as). A null key is shared with nothing. Of the keys only
    first rows meet, so a key that a third of all rows have is one row a task.
    """
    own = {path: F.col(path), order: F.col(order)}
    keyed, single = batch.filter(F.col(key).isNotNull()), batch.filter(F.col(key).isNull())
    first = keyed.groupBy(key).agg(F.min(F.struct(order, path)).alias("_f")).select(key, F.col(f"_f.{path}").alias("_first"))
    if held is not None:
        first = first.join(held.select(key), key, "left_anti")
    lead = keyed.join(first, key).filter(F.col(path) == F.col("_first")).drop("_first").dropDuplicates([key])
    decided = materialised(decide(lead.unionByName(single)).withColumn("same_as", F.lit(None).cast("string")), "stream-decided")
    names = decided.columns
    source = decided.filter(F.col(key).isNotNull())
    if held is not None:
        source = source.unionByName(held.select(names))
    taken = source.select(F.col(key).alias("_k"), F.struct(*[c for c in names if c not in own]).alias("_r"), F.col(path).alias("_by"))
    rest = keyed.select(F.col(key).alias("_k"), *own).join(decided.select(path), path, "left_anti").join(taken, "_k")
    shown = [F.col(c) if c in own else F.col("_by").alias(c) if c == "same_as" else F.lit(True).alias(c) if c == "cached" else F.col(f"_r.{c}").alias(c) for c in names]
    return decided.unionByName(rest.select(*shown))


def start(stream: DataFrame, decide: Callable[[DataFrame], DataFrame], journal: str, run_id: str, checkpoint: str, key: str | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Decide each micro-batch once and commit it to the journal as a wave of run_id; one that was committed is not written again.

    prepare: makes rows of a batch (path, plan_ord, key, ...) from what the stream brings. key: the column
    by which rows of all batches are the same; without one every row is decided.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if not sinks.commits(spark, journal, run_id).filter(F.col("wave") == epoch).isEmpty():
            return
        rows = prepare(batch) if prepare else batch
        if key is None:
            sinks.append_rows(decide(rows), journal, run_id, epoch)
            return
        held = known(spark, journal, run_id, key)
        once = materialised(rows, "stream-batch")
        sinks.append_rows(joined(once, decide, held, key), journal, run_id, epoch)
        drop(once)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
