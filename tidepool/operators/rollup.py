"""The map of a vault: totals, every folder with all below it, the link graph, copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as T

from .index import was_read

DEGREE_CLIP, HUBS = 20, 20


def counted(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, value, n: how often each value comes."""
    return df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))


def noted(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for every planned note: its facts, and what the run's latest row says of it, null if it has none.

    facts: rel, status, rule, undecodable and the facts of the index. rows: path, kind, judge, cached,
    bucket, suggested_bucket, action, skipped, findings, age_source, exact_duplicate_of.
    """
    said = ["kind", "judge", "cached", "bucket", "suggested_bucket", "action", "skipped", "findings", "age_source", "exact_duplicate_of"]
    kept = facts.drop(*said)
    return kept.join(rows.select(F.col("path").alias("rel"), *said), "rel", "left")


def _counters(notes: DataFrame) -> dict[str, Column]:
    """What is counted of each note, as a number or a condition, wherever it is added up."""
    vote, read, skip = F.col("kind") == "vote", was_read(), F.col("status") != "scan"
    source = F.col("age_source")
    n = {
        "judged": vote, "local": vote & (F.col("judge") == "local"), "cached": vote & F.coalesce("cached", F.lit(False)), "review": vote & F.col("suggested_bucket").isNotNull(),
        "quarantined": vote & (F.col("action") == "quarantine"), "locked": F.col("skipped") == "locked", "withheld": skip, "errors": F.col("kind") == "error",
        "age_from_mtime": vote & (source == "mtime"), "dated": vote & (source == "frontmatter"), "stamp_dated": vote & (source == "stamp"),
        "orphans": read & F.col("is_orphan"), "mocs": read & F.col("is_moc"),
    }
    one = {k: F.coalesce(c, F.lit(False)).cast("long") for k, c in n.items()}
    return one | {c: F.when(read, F.coalesce(c, F.lit(0))).otherwise(0).cast("long") for c in ("words", "in_links", "out_links", "unresolved_links")}


#: Counters by value, each a map.
MAPS = ("buckets", "judges", "skipped", "findings", "age_bands")


def _tags(notes: DataFrame) -> Column:
    """kind and value of what a note counts for in the maps: an array of structs."""
    vote = F.col("kind") == "vote"
    tag = lambda kind, cond, value: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(kind).alias("of"), value.cast("string").alias("value")))
    one = [
        tag("buckets", vote, F.col("bucket")), tag("judges", vote, F.coalesce("judge", F.lit("judged"))), tag("skipped", F.col("status") != "scan", F.col("rule")),
        tag("age_bands", was_read(), F.coalesce(T.banded_age("age_days").cast("string"), F.lit("unknown"))),
    ]
    found = F.transform(F.coalesce("findings", F.array().cast("array<string>")), lambda f: F.struct(F.lit("findings").alias("of"), f.alias("value")))
    return F.concat(F.filter(F.array(*one), lambda x: x.isNotNull() & x["value"].isNotNull()), found)


def _rolled(notes: DataFrame, chain: Column) -> DataFrame:
    """A row for each folder of the chains: notes, all counters and maps.

    One aggregation over counters and tags: a note is taken apart once for every folder above it and
    tag, equal ones are summed before the shuffle, and what is left, a row for each folder, map and value,
    is put together by folder.
    """
    numbers = _counters(notes)
    total = F.struct(F.lit(1).cast("long").alias("notes"), *[c.alias(k) for k, c in numbers.items()])
    nothing = F.lit(None).cast(f"struct<notes: bigint, {', '.join(f'{k}: bigint' for k in numbers)}>")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("of"), F.lit(None).cast("string").alias("value"), total.alias("n")))
    tagged = F.transform(_tags(notes), lambda x: F.struct(x["of"].alias("of"), x["value"].alias("value"), nothing.alias("n")))
    parts = notes.select(chain.alias("_chain"), F.concat(whole, tagged).alias("_parts")).select(F.explode("_chain").alias("folder"), "_parts").select("folder", F.inline("_parts"))
    names = ["notes", *numbers]
    sums = parts.groupBy("folder", "of", "value").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(f"n.{k}").alias(k) for k in names])
    entry = lambda of: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("of") == of, F.struct("value", "_rows")))))
    return sums.groupBy("folder").agg(*[F.max(k).alias(k) for k in names], *[entry(m).alias(m) for m in MAPS])


def folder_map(notes: DataFrame) -> DataFrame:
    """One row per folder, `./` for the root, for all notes in it and below: a note counts once in every folder above it.

    notes: as noted() gives them. Numbers: notes, judged (the local judge's votes too), local, cached,
    review, quarantined, locked, withheld, errors, ages by their source, orphans, mocs, words and links,
    of notes that were read. Maps from value to notes: buckets, judges, skipped (by rule), findings,
    age_bands (by their lower end, or unknown). No folder is a hot key, the root neither.
    """
    return _rolled(notes, T.folder_chain("rel"))


def totals(notes: DataFrame) -> DataFrame:
    """The same in one row for the whole vault."""
    return _rolled(notes, F.array(F.lit("./"))).drop("folder")


def graph_totals(facts: DataFrame) -> DataFrame:
    """nodes, edges (links that lead to a note), unresolved, orphans, mocs over notes that were read."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return facts.filter(was_read()).agg(
        F.count(F.lit(1)).alias("nodes"), total(F.col("out_links") - F.col("unresolved_links")).alias("edges"), total(F.col("unresolved_links")).alias("unresolved"),
        F.count_if("is_orphan").alias("orphans"), F.count_if("is_moc").alias("mocs"),
    )


def degree_histogram(facts: DataFrame, column: str) -> DataFrame:
    """degree, notes; degrees above twenty count as twenty."""
    return facts.filter(F.col(column).isNotNull() & was_read()).groupBy(F.least(column, F.lit(DEGREE_CLIP)).alias("degree")).agg(F.count(F.lit(1)).alias("notes"))


def hubs(facts: DataFrame, n: int = HUBS) -> DataFrame:
    """rel, in_links of the scanned notes most linked to; equal ones in plan order. Withheld paths are never listed."""
    return facts.filter(was_read() & (F.col("in_links") > 0)).orderBy(F.desc("in_links"), "plan_ord").limit(n).select("rel", "in_links")


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """canonical, copies: from result rows, so notes that were skipped or locked are in none."""
    return rows.filter("exact_duplicate_of IS NOT NULL").groupBy(F.col("exact_duplicate_of").alias("canonical")).agg(F.array_sort(F.collect_list("path")).alias("copies"))
