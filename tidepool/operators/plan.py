"""Which notes may be read, decided from their paths alone.

Every function takes and gives DataFrames; `rel` is the path below the root. A plan keeps plan_ord,
the place of a note in component order, which all later ties go by.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import text as T

WORKING_FOLDER = "_tidepool"


def with_order(df: DataFrame, rel: str = "rel") -> DataFrame:
    """df with plan_ord: a key that sorts as path components do.

    Components are joined by a character below all others, so that the key compares as text and no
    global row number, hence no single task, is needed.
    """
    return df.withColumn("plan_ord", F.translate(F.col(rel), "/", "\x01"))


def status(rel: Column, names: tuple[str, ...] = T.SENSITIVE_NAMES, include_sensitive: bool = False, root: str = "") -> Column:
    """struct<status, rule>: hidden, then the tool's own folder, then sensitive, then scan; the first that fits.

    root: the operator's own target below the vault; its folders count as the notes' own do.
    """
    full = F.concat(F.lit(root.rstrip("/") + "/" if root else ""), rel)
    parts = T.path_parts(full)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def of(sensitive: Column) -> Column:
        out = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("rule"), sensitive.alias("sensitive"))
        return (
            F.when(F.exists(parts, lambda p: F.startswith(p, F.lit("."))), out("skip", "hidden"))
            .when(F.array_contains(folders, WORKING_FOLDER), out("skip", "tidepool"))
            .when(sensitive & F.lit(not include_sensitive), out("skip", "sensitive"))
            .otherwise(out("scan", None))
        )

    return T.let(T.path_is_sensitive(full, names), of)


def plan(df: DataFrame, names: tuple[str, ...] = T.SENSITIVE_NAMES, include_sensitive: bool = False, root: str = "") -> DataFrame:
    """df (with rel) with plan_ord, folder, status, rule, sensitive. No content is looked at."""
    out = with_order(df).withColumn("_s", status(F.col("rel"), names, include_sensitive, root))
    return out.select(*df.columns, "plan_ord", T.folder("rel").alias("folder"), "_s.status", F.col("_s.rule").cast("string").alias("rule"), "_s.sensitive")


def counts(planned: DataFrame) -> DataFrame:
    """folder, status, rule, notes: what is included and what is skipped, and why."""
    return planned.groupBy("folder", "status", "rule").agg(F.count(F.lit(1)).alias("notes"))


def near_misses(planned: DataFrame, names: tuple[str, ...] = T.SENSITIVE_NAMES) -> DataFrame:
    """segment, name, rel: scanned folders that hold a sensitive name inside a longer word, with the first note in plan order."""
    segments = planned.filter("status = 'scan'").select("rel", "plan_ord", F.explode(F.array_distinct(F.slice(T.path_parts("rel"), F.lit(1), F.size(T.path_parts("rel")) - 1))).alias("segment"))
    first = F.coalesce(*[F.when(F.contains(F.lower("segment"), F.lit(n.lower())) & ~T.segment_matches("segment", n), F.lit(n)) for n in names])
    found = segments.withColumn("name", first).filter("name IS NOT NULL")
    return found.groupBy("segment").agg(F.min(F.struct("plan_ord", "name", "rel")).alias("m")).select("segment", "m.name", "m.rel")


def vault_root(spark: SparkSession, target: str, marker: str = ".obsidian") -> str | None:
    """The nearest folder at or above a target that holds the marker; None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    while path is not None:
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(path, marker)):
            return path.toUri().getPath()
        path = path.getParent()
    return None


def refuse_root(target: str, vault: str, names: tuple[str, ...] = T.SENSITIVE_NAMES, include_sensitive: bool = False) -> None:
    """Raises if a folder above the vault has a sensitive name: its notes would count as public."""
    if include_sensitive:
        return
    above = PurePosixPath(vault).parts
    for segment in above:
        words = _words(segment)
        for name in names:
            want = _words(name)
            if want and any(words[i : i + len(want)] == want for i in range(len(words))):
                raise ValueError(f"{target}: the vault lies under a folder named {segment!r}")


def _words(segment: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", segment.lower())
