"""A small sample that every kind of note is in, and spot checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.functions import text as T

SAMPLE, SPOT_CHECK = 75, 20


def shuffled(seed: int, *columns: str):
    """An order that looks random and is the same everywhere."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *columns), 256)


def strata(eligible: DataFrame) -> DataFrame:
    """eligible (rel, words, age_days) with stratum: top folder, length band, age band."""
    age = F.coalesce(T.banded_age("age_days").cast("string"), F.lit("unknown"))
    return eligible.withColumn("stratum", F.concat_ws(" | ", T.survey_folder("rel"), T.length_band("words"), age))


def sample(eligible: DataFrame, n: int = SAMPLE, seed: int = 0) -> DataFrame:
    """n notes, one of each stratum before a second of any.

    Within a stratum only its first n notes by the seeded order can be drawn, and those are found
    before any stratum is gathered.
    """
    df = strata(eligible).withColumn("_o", shuffled(seed, "rel"))
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy("stratum").orderBy("_o"))).filter(F.col("_rn") <= n)
    return ranked.orderBy("_rn", shuffled(seed, "stratum"), "_o").limit(n).drop("_o", "_rn")


def coverage(eligible: DataFrame, sampled: DataFrame) -> DataFrame:
    """stratum, population, sampled."""
    a = strata(eligible).groupBy("stratum").agg(F.count(F.lit(1)).alias("population"))
    b = sampled.groupBy("stratum").agg(F.count(F.lit(1)).alias("sampled"))
    return a.join(b, "stratum", "left").select("stratum", "population", F.coalesce("sampled", F.lit(0)).alias("sampled"))


def distribution(sampled: DataFrame, rows: DataFrame) -> DataFrame:
    """stratum, bucket, n among the sampled notes that were judged."""
    return sampled.join(rows.select(F.col("path").alias("rel"), "bucket"), "rel").groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))


def spot_check(rows: DataFrame, n: int = SPOT_CHECK, seed: int = 0) -> DataFrame:
    """Confident notes to look at by hand."""
    return rows.filter("kind = 'vote' AND judge = 'judged' AND suggested_bucket IS NULL").orderBy(shuffled(seed, "path")).limit(n)
