"""One row per planned note with all that later steps know of it, and the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import redaction as R
from tidepool.functions import text as T

# Fixed values.
MOC_LINKS, MOC_WORDS_PER_LINK, ORPHAN_DAYS, SPARSE_SHARE = 8, 20, 30, 0.05


def was_read() -> Column:
    """Whether a note was opened and could be decoded; others keep their path and have no facts."""
    return (F.col("status") == "scan") & F.col("undecodable").isNull()


def index(planned: DataFrame, today: str, names: list[str] | None = None) -> DataFrame:
    """Facts of every note: title, digest, counts, links, aliases, lock, age.

    planned: rel, plan_ord, folder, status, sensitive, body, and, where known, header fields
    (header_title, aliases, keys, locked, created, stamped, header_error) and modified. Skipped notes and
    those that can't be decoded keep their path, so that links to them resolve, and have no facts.
    """
    defaults = {
        "header_title": "string", "aliases": "array<string>", "keys": "array<string>", "locked": "boolean", "created": "date",
        "stamped": "date", "modified": "timestamp", "header_error": "string", "undecodable": "string",
    }
    df = planned.withColumns({c: F.lit(None).cast(t) for c, t in defaults.items() if c not in planned.columns})
    scanned = was_read()
    stem = F.regexp_replace(F.element_at(T.path_parts("rel"), -1), r"\.md$", "")
    heading = F.when(F.contains("body", F.lit("# ")), F.trim(F.regexp_extract("body", r"(?m)^# (.*)$", 1)))
    given = F.coalesce(F.nullif(T.strip("header_title"), F.lit("")), F.nullif(heading, F.lit("")))
    df = df.withColumns({"_given": F.when(scanned, given), "_stem": F.when(scanned, stem)}).withColumn("_spaced", F.translate("_stem", "-_", "  "))
    df = R.redacted_together(df, {f"{c}_redacted": F.col(c) for c in ("_given", "_stem", "_spaced")}, names, "_hits")
    # a name that holds something to redact stays as it is, so that it is recognised again
    kept = F.col("_stem_redacted") != F.col("_stem")
    df = df.withColumns(
        {
            "title": F.coalesce("_given", F.when(kept, F.col("_stem")).otherwise(F.col("_spaced"))),
            "title_redacted": F.when(F.col("_given").isNotNull(), F.col("_given_redacted")).when(kept, F.col("_stem_redacted")).otherwise(F.col("_spaced_redacted")),
        }
    )
    shown = F.regexp_extract_all("title_redacted", F.lit(r"\[([A-Z_]+)\]"), F.lit(1))
    df = df.withColumn("_title_hits", F.array_intersect("_hits", shown))
    links = F.when(scanned, T.parsed_links("body"))
    df = df.select("*", F.explode(F.array(links)).alias("_links")).withColumn("_words", T.words_counted(F.when(scanned, F.col("body"))))
    fact = lambda c: F.when(scanned, c)
    df = df.withColumns(
        {
            "digest": fact(T.body_digest("body")),
            "words": fact(F.col("_words")),
            "headings": fact(T.heading_count("body")),
            "empty": fact(T.body_is_empty("body")),
            "links": F.col("_links.targets"),
            "embeds": F.col("_links.embeds"),
            "aliases": fact(T.clean_aliases("aliases")),
            "locked": fact(F.coalesce("locked", F.lit(False))),
            "title_credential": fact(R.acts_alone(F.col("_title_hits"))),
            "age_source": fact(F.when(F.coalesce(F.col("created"), F.col("stamped"), F.col("modified").cast("date")).isNotNull(), T.age_source("created", "stamped"))),
            "age_days": fact(T.age_days("created", "stamped", "modified", today)),
        }
    )
    return df.drop(*[c for c in df.columns if c.startswith("_")], "header_title")


def exact_duplicates(indexed: DataFrame) -> DataFrame:
    """indexed with exact_duplicate_of: the first note in plan order with the same digest, null for that one itself."""
    first = indexed.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("plan_ord", "rel")).alias("_f"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    joined = indexed.join(first.select("digest", F.col("_f.rel").alias("_first")), "digest", "left")
    return joined.withColumn("exact_duplicate_of", F.when(F.col("_first") != F.col("rel"), F.col("_first"))).drop("_first").select(*indexed.columns, "exact_duplicate_of")


def resolved_links(indexed: DataFrame) -> DataFrame:
    """rel, target, place, resolved: each link of a scanned note with the note it leads to, null if none.

    Names are compared in lower case by their last component, over all planned notes; a target with a
    path must be the note's path or its end. Of several the first in plan order is taken.
    """
    name = lambda c: F.lower(F.element_at(T.path_parts(c), -1))
    plain = F.regexp_replace("rel", r"(?i)\.md$", "")
    notes = indexed.select(F.col("rel").alias("to"), F.col("plan_ord").alias("to_ord"), F.lower(plain).alias("to_path"), name(plain).alias("name"))
    links = indexed.filter(was_read()).select("rel", F.posexplode("links").alias("place", "target"))
    links = links.withColumn("want", F.lower(F.trim(F.col("target"), F.lit("/")))).withColumn("name", name(F.col("want")))
    bare = ~F.contains("want", F.lit("/"))
    # targets repeat: each is resolved once, and many notes of one name meet only its distinct targets
    targets = links.select("want", "name").distinct()
    fits = bare | (F.col("to_path") == F.col("want")) | F.endswith("to_path", F.concat(F.lit("/"), F.col("want")))
    found = targets.join(notes, "name").filter(fits).groupBy("want", "name").agg(F.min(F.struct("to_ord", "to")).alias("_t"))
    return links.join(found, ["want", "name"], "left").select("rel", "target", "place", F.col("_t.to").alias("resolved"))


def link_facts(indexed: DataFrame, single_file: bool = False) -> DataFrame:
    """indexed with out_links, in_links, unresolved_links, is_moc, is_orphan.

    out_links counts all links, those that lead nowhere too. Links to oneself don't count as incoming. in_links and is_orphan are unknown for a single file;
    is_orphan is unknown too if under one in twenty notes link at all.
    """
    links = resolved_links(indexed)
    none, leads = F.lit(0), F.col("resolved").isNotNull()
    ends = F.array(
        F.struct("rel", F.lit(1).alias("out"), F.when(leads, 0).otherwise(1).alias("un"), none.alias("in")),
        F.struct(F.col("resolved").alias("rel"), none.alias("out"), none.alias("un"), F.when(F.col("resolved") != F.col("rel"), 1).otherwise(0).alias("in")),
    )
    # both ends of every link are counted together, so that notes meet their counts once
    counts = links.select(F.inline(ends)).filter("rel IS NOT NULL").groupBy("rel").agg(*[F.sum(c).cast("int").alias(f"_{c}") for c in ("out", "un", "in")])
    scanned = was_read()
    df = indexed.join(counts, "rel", "left")
    df = df.withColumns({"out_links": F.when(scanned, F.coalesce("_out", F.lit(0))), "unresolved_links": F.when(scanned, F.coalesce("_un", F.lit(0)))})
    df = df.withColumn("in_links", F.when(scanned & F.lit(not single_file), F.coalesce("_in", F.lit(0))))
    linked = indexed.select("status", "undecodable", F.size(F.coalesce("links", F.array().cast("array<string>"))).alias("out_links"))
    share = linking_share(linked).select(F.col("share").alias("_share"))
    df = df.crossJoin(F.broadcast(share))  # one row
    moc = (F.col("out_links") >= MOC_LINKS) & (F.col("words") <= MOC_WORDS_PER_LINK * F.col("out_links"))
    old = F.col("age_days").isNull() | (F.col("age_days") >= ORPHAN_DAYS)
    orphan = F.when(F.lit(not single_file) & (F.col("_share") >= SPARSE_SHARE), (F.col("in_links") == 0) & old)
    df = df.withColumns({"is_moc": F.when(scanned, moc), "is_orphan": F.when(scanned, orphan)})
    added = ["out_links", "in_links", "unresolved_links", "is_moc", "is_orphan"]
    return df.select(*indexed.columns, *added)


def linking_share(facts: DataFrame) -> DataFrame:
    """share: notes that link to anything, resolved or not, among all that were read."""
    links = (F.col("out_links") > 0).cast("double")
    return facts.filter(was_read()).agg(F.coalesce(F.avg(links), F.lit(0.0)).alias("share"))


def graph_state() -> Column:
    """The facts as they are sent: words and age in bands, so that small edits don't move them."""
    return F.struct(
        T.banded_words("words").alias("words"), "headings", T.banded_age("age_days").alias("age_days"), "out_links", "in_links", "embeds", "unresolved_links", "is_moc", "is_orphan"
    )
