"""Token counts through a digest cache.

A text's key is the digest of its normalised content together with the digest of the tokenizer file.
Keys join a stored table of counts; only distinct texts that are missing there are encoded, and their
counts are appended to the table. The tokenizers here count every byte, so normalising content may
only turn null into the empty text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_HOT, arrow_map, materialise, new_table, whole_text
from .encoding import pieces_of, version_digest

#: Digests of missing texts that go to every executor, about 100 bytes each; beyond that copies are folded first.
FEW_MISSING = 300_000
CACHE_SCHEMA = "content string, version string, n_tokens long"


def cached_counts(df: DataFrame, cache: str, tokenizer: str, text: str = "text") -> DataFrame:
    """df's rows with content (sha256 of the normalised text) and n_tokens.

    cache: path of the table of counts; it is made if there is none yet, and gets one row for each
    distinct text it lacks. Null and empty texts have 0 tokens. Repeated texts are encoded once. A
    table of no rows gives no rows. Columns of df named content or n_tokens are replaced. Running
    two of these at once on one cache may append a count twice; that is harmless.
    """
    spark = df.sparkSession
    version = version_digest(tokenizer)
    keyed = df.drop("content", "n_tokens").withColumn("content", F.sha2(whole_text(text), 256))
    where = spark._jvm.org.apache.hadoop.fs.Path(cache)
    held = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    texts = keyed.select("content", whole_text(text).alias("text"))
    if held:
        # digests alone meet the cache; texts are looked for only if any are missing
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("version") == version)
        missing = materialise(keyed.select("content").distinct().join(stored.select("content"), "content", "left_anti"), "token-missing")
        if missing.count() <= FEW_MISSING:
            texts = texts.join(F.broadcast(missing), "content", "left_semi")
    # copies meet before the shuffle, so that a text that a third of all rows have is one row a task
    misses = texts.groupBy("content").agg(F.first("text").alias("text"))
    if held and missing.count() > FEW_MISSING:
        misses = misses.join(missing, "content", "left_semi")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = pieces_of(tokenizer)
        counts = [encoder.count(t.as_py()) for t in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    fresh = arrow_map(misses, count, "content string, n_tokens long")
    fresh.select("content", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    counts = (
        spark.read.schema(CACHE_SCHEMA)
        .parquet(cache)
        .filter(F.col("version") == version)
        .groupBy("content")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    rows = keyed.count()
    copies = keyed.groupBy("content").agg(F.count(F.lit(1)).alias("_copies")).filter(F.col("_copies") * MOST_HOT > rows)
    copies = materialise(copies, "token-hot")
    # texts that many rows have reach them by broadcast, fewer than MOST_HOT
    hot = F.broadcast(counts.join(F.broadcast(copies.drop("_copies")), "content", "left_semi"))
    rest = keyed.join(F.broadcast(copies.drop("_copies")), "content", "left_anti").join(counts, "content")
    return keyed.join(hot, "content").unionByName(rest)


def token_counts(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, cache: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), content for every row of df.

    cache: table that lasts between runs; without one, a new one in the shared folder.
    Only doc_id and text of df are read; a null doc_id stays null, repeated rows stay repeated.
    """
    slim = df.select("doc_id", "text", F.octet_length(whole_text()).cast("long").alias("n_bytes"))
    counted = cached_counts(slim, cache or new_table(df.sparkSession, "token-cache"), tokenizer)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "content")
