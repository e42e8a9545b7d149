"""What it would withhold besides, if a folder's name were added to the sensitive names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as T


def withheld(folders: DataFrame, names: tuple[str, ...] = T.SENSITIVE_NAMES) -> DataFrame:
    """folders (folder, as in reports) with withheld: whether a name of the list matches a folder of its path."""
    parts = F.split("folder", "/")
    found = F.lit(False)
    for name in names:
        if name.strip():
            found = found | F.exists(parts, _matches(name))
    return folders.withColumn("withheld", found)


def _matches(name: str):
    return lambda part: T.segment_matches(part, name)


def collateral(folders: DataFrame, targets: DataFrame, names: tuple[str, ...] = T.SENSITIVE_NAMES, together: bool = False) -> DataFrame:
    """folder, name, others (sorted) of every target: the folders that its name would withhold besides.

    A target's subfolders are meant, and what the list withholds already is not new; together counts
    other targets as meant too. Folders meet names through a name's first word, not all with all.
    """
    name = F.when(F.col("folder") == ".", ".").otherwise(F.element_at(F.split("folder", "/"), -1))
    wanted = targets.select("folder").distinct().withColumn("name", name).withColumn("word", F.get(T.words_of_name("name"), F.lit(0)))
    segments = withheld(folders.select("folder").distinct(), names).filter("NOT withheld").select(F.col("folder").alias("f"), F.explode(F.array_distinct(F.split("folder", "/"))).alias("segment"))
    words = segments.select("f", "segment", F.explode(F.array_distinct(T.words_of_name("segment"))).alias("word"))
    meant = (F.col("f") == F.col("folder")) | F.startswith("f", F.concat("folder", F.lit("/")))
    met = words.join(wanted, "word").filter(T.segment_matches("segment", F.col("name")) & ~meant)
    if together:
        inside = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("f", "/"))), lambda n: F.array_join(F.slice(F.split("f", "/"), F.lit(1), n), "/")))
        above = met.select("f").distinct().select("f", inside.alias("folder")).join(targets.select("folder"), "folder", "left_semi").select("f").distinct()
        met = met.join(above, "f", "left_anti")
    found = met.groupBy("folder").agg(F.array_sort(F.collect_set("f")).alias("others"))
    out = wanted.select("folder", "name").join(found, "folder", "left")
    return out.withColumn("others", F.coalesce("others", F.array().cast("array<string>")))


def flag(names: tuple[str, ...], added: list[str]) -> str:
    """The names to pass: the list replaces the one before, so it holds all of that and the new ones."""
    return "--sensitive-paths " + ",".join(dict.fromkeys([*names, *added]))
